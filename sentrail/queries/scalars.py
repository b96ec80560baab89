"""Scalar functions (SC rows) and line-oriented sources over columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrail.functions import scalars as S
from sentrail.functions.times import coerce_ts
from sentrail.session import table


def sc1_joint_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", S.joint_hash(F.sha2("n_name", 256), F.col("n_regionkey").cast("string")).alias("h"))


def sc3_hash_choice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(S.hash_choice(F.coalesce("text", F.lit("")), 4).alias("choice")).agg(F.count(F.lit(1)).alias("n"))


def sc4_base64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.base64(F.encode("n_name", "utf-8")).alias("b"), F.decode(F.unbase64(F.base64(F.encode("n_name", "utf-8"))), "utf-8").alias("back"))


def sc5_json_block(spark: SparkSession, d: str) -> DataFrame:
    """The first flat JSON object in a text, with defaults."""
    e = table(spark, d, "events").withColumn("t", F.concat(F.lit("answer: "), F.col("props"), F.lit(" end")))
    s = F.from_json(F.regexp_extract("t", r"(\{[^{}]*\})", 1), "k INT, level STRING")
    return e.select("event_id", F.coalesce(s["k"], F.lit(-1)).alias("k"), F.coalesce(s["level"], F.lit("L2")).alias("level"))


def sc8_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.substring("text", 1, 200).alias("head"), F.length("text").alias("n"))


def sc9_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.element_at(F.split("c_name", "#"), 2).cast("int").alias("no"))


def sc10_regex_transform(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.transform_regex(F.col("p_name"), {"small|red": "x", " +": "_"}).alias("name"))


def sc11_named_groups(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "behavior_events").select(S.named_groups(F.col("target"), r"^https?://(?<host>[^/:?#]+)[^/]*/(?<rest>[^?#]*)").alias("g")).filter("g IS NOT NULL")
    return u.groupBy("g.host").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("g.rest").alias("n_paths"))


def sc12_grok(spark: SparkSession, d: str) -> DataFrame:
    g = S.grok(F.col("p_brand"), "%{WORD:kind}#%{INT:no:int}")
    return table(spark, d, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.kind", "g.no")


def sc13_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.format_string("%05d:%s", "s_suppkey", F.lower("s_name")).alias("f"), F.trim(F.substring("s_name", 1, 4)).alias("h"), F.length("s_name").alias("n"))


def sc14_humanize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", S.humanize(F.col("o_orderkey") * F.col("o_orderkey")).alias("size"))


def sc15_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat_ws("/", F.lit("/srv"), "source", "doc_type", "file_name")
    return table(spark, d, "documents").select("doc_id", S.basename(p).alias("base"), S.dirname(p).alias("dir"), S.path_part(p, 0).alias("first"), S.path_part(p, -2).alias("parent"))


def sc16_render(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", S.render("{{name}}  of   {region} {{missing}}", {"name": F.col("n_name"), "region": F.col("n_regionkey")}).alias("text"))


def sc17_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object(F.to_json(F.struct("event_type", "user_id")), "$.user_id").cast("long").alias("u"))


def sc19_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.md5("p_name").alias("m"), F.sha1("p_name").alias("s"))


def sc20_multi_hot(spark: SparkSession, d: str) -> DataFrame:
    v = S.multi_hot(F.split("p_type", " "), ["ECONOMY", "PROMO", "STANDARD"])
    return table(spark, d, "part").select("p_partkey", v[0].alias("a"), v[1].alias("b"), v[2].alias("c"))


def sc23_urls(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"https?://[A-Za-z0-9./_-]+"), F.lit(0))).alias("url"))
    return u.groupBy("url").agg(F.count(F.lit(1)).alias("n"))


def sc30_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """The same times written in four notations, read back."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    texts = F.array(t.cast("string"), (t * 1000).cast("string"), F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    e = table(spark, d, "events").select("event_id", F.posexplode(texts).alias("i", "t"))
    return e.select("event_id", "i", F.unix_seconds(coerce_ts(F.col("t"))).alias("s"))


def sc33_binomial(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.round(S.binomial_tail(5, F.col("n_nationkey") / 25), 6).alias("p"))


def sc34_dicts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return m.select("n_regionkey", F.size("m").alias("n"), F.array_max(F.map_values("m")).alias("largest"))


def sc36_branches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_totalprice") > 100000, "medium").otherwise("small").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def sc41_ranks(spark: SparkSession, d: str) -> DataFrame:
    from sentrail.functions.canon import level_key

    e = table(spark, d, "behavior_events").select(level_key(F.col("sensitivity_level")).alias("level"), "action")
    return e.groupBy("action").agg(F.max("level").alias("highest"), F.count_if(F.col("level").isNull()).alias("n_unknown"))


def src14_csv_text(spark: SparkSession, d: str) -> DataFrame:
    s = F.from_csv(F.concat_ws(",", "s_suppkey", "s_name", "s_acctbal"), F.lit("k BIGINT, name STRING, bal DOUBLE"))
    return table(spark, d, "supplier").select(s.alias("s")).select("s.*")


def src15_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter("line <> ''")
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last"))


def src16_records(spark: SparkSession, d: str) -> DataFrame:
    """Every 'Name: value' line of the documents' heads as a row."""
    r = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|\n)((?:Owner|Host|Reference): [^\n]+)"), F.lit(1))).alias("r"))
    return r.groupBy(F.regexp_extract("r", r"^([A-Za-z]+): ", 1).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.regexp_extract("r", r"^[A-Za-z]+: (.*)$", 1)).alias("n_values"))


def src17_split_records(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("i", "para"))
    return t.select("doc_id", "i", F.element_at(F.split("para", ": "), 1).alias("head")).filter("length(head) < 12")


def src18_read_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.substring("p_name", 3, 4).alias("piece"))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__}
ORACLES = {
    "sc1_joint_hash": "SELECT n_nationkey, sha256(sha256(n_name) || '||' || n_regionkey::VARCHAR) AS h FROM nation",
    "sc3_hash_choice": "SELECT (('0x' || md5(coalesce(text, ''))[1:8])::BIGINT % 4)::INTEGER AS choice, count(*) AS n FROM documents GROUP BY 1",
    "sc4_base64": "SELECT n_nationkey, to_base64(encode(n_name)) AS b, n_name AS back FROM nation",
    "sc5_json_block": "SELECT event_id, coalesce((props::JSON->>'k')::INTEGER, -1) AS k, coalesce(props::JSON->>'level', 'L2') AS level FROM events",
    "sc8_truncate": "SELECT doc_id, text[1:200] AS head, length(text)::INTEGER AS n FROM documents WHERE text IS NOT NULL",
    "sc9_split": "SELECT c_custkey, string_split(c_name, '#')[2]::INTEGER AS no FROM customer",
    "sc10_regex_transform": "SELECT p_partkey, regexp_replace(regexp_replace(p_name, 'small|red', 'x', 'g'), ' +', '_', 'g') AS name FROM part",
    "sc11_named_groups": r"SELECT regexp_extract(target, '^https?://([^/:?#]+)[^/]*/([^?#]*)', 1) AS host, count(*) AS n, count(DISTINCT regexp_extract(target, '^https?://([^/:?#]+)[^/]*/([^?#]*)', 2)) AS n_paths FROM behavior_events WHERE regexp_matches(target, '^https?://([^/:?#]+)[^/]*/') GROUP BY 1",
    "sc12_grok": "SELECT p_partkey, string_split(p_brand, '#')[1] AS kind, string_split(p_brand, '#')[2]::BIGINT AS no FROM part",
    "sc13_formats": "SELECT s_suppkey, printf('%05d:%s', s_suppkey, lower(s_name)) AS f, trim(s_name[1:4]) AS h, length(s_name)::INTEGER AS n FROM supplier",
    "sc14_humanize": "SELECT o_orderkey, CASE WHEN x < 1000 THEN x || ' B' WHEN x < 1000000 THEN printf('%.1f', round(x / 1e3, 1)) || ' kB' WHEN x < 1000000000 THEN printf('%.1f', round(x / 1e6, 1)) || ' MB' WHEN x < 1000000000000 THEN printf('%.1f', round(x / 1e9, 1)) || ' GB' ELSE printf('%.1f', round(x / 1e12, 1)) || ' TB' END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS x FROM orders)",
    "sc15_paths": "SELECT doc_id, l[-1] AS base, array_to_string(l[:-2], '/') AS dir, 'srv' AS first, coalesce(nullif(l[-2], ''), NULL) AS parent FROM (SELECT doc_id, string_split(concat_ws('/', '/srv', source, doc_type, file_name), '/') AS l FROM documents)",
    "sc16_render": "SELECT n_nationkey, n_name || ' of ' || n_regionkey AS text FROM nation",
    "sc17_json": "SELECT event_id, user_id AS u FROM events",
    "sc19_hashes": "SELECT p_partkey, md5(p_name) AS m, sha1(p_name) AS s FROM part",
    "sc20_multi_hot": "SELECT p_partkey, list_contains(t, 'ECONOMY')::INT::DOUBLE AS a, list_contains(t, 'PROMO')::INT::DOUBLE AS b, list_contains(t, 'STANDARD')::INT::DOUBLE AS c FROM (SELECT p_partkey, string_split(p_type, ' ') AS t FROM part)",
    "sc23_urls": "SELECT url, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+')) AS url FROM documents) GROUP BY 1",
    "sc30_timestamps": "SELECT event_id, i, floor(epoch(ts))::BIGINT AS s FROM events, (SELECT unnest([0, 1, 2, 3])::INTEGER AS i)",
    "sc33_binomial": "SELECT n_nationkey, round(10 * pow(p, 3) * pow(1 - p, 2) + 5 * pow(p, 4) * (1 - p) + pow(p, 5), 6) AS p FROM (SELECT n_nationkey, n_nationkey / 25 AS p FROM nation)",
    "sc34_dicts": "SELECT n_regionkey, count(*)::INTEGER AS n, max(n_nationkey) AS largest FROM nation GROUP BY 1",
    "sc36_branches": "SELECT CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size, count(*) AS n FROM orders GROUP BY 1",
    "src14_csv_text": "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier",
    "src15_lines": "SELECT doc_id, count(*) AS n_lines, max(i)::INTEGER AS last FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE x <> '' GROUP BY 1",
    "src16_records": "SELECT regexp_extract(r, '([A-Za-z]+): ', 1) AS name, count(*) AS n, count(DISTINCT regexp_extract(r, ': (.*)$', 1)) AS n_values FROM (SELECT unnest(string_split(text, chr(10))) AS r FROM documents) WHERE regexp_matches(r, '^(Owner|Host|Reference): .') GROUP BY 1",
    "src17_split_records": "SELECT doc_id, i::INTEGER AS i, string_split(x, ': ')[1] AS head FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents)) WHERE length(string_split(x, ': ')[1]) < 12",
    "src18_read_range": "SELECT p_partkey, p_name[3:6] AS piece FROM part",
}
from sentrail.queries.features import level_sql  # noqa: E402

ORACLES["sc41_ranks"] = f"SELECT action, max({level_sql('sensitivity_level')}) AS highest, count(*) FILTER ({level_sql('sensitivity_level')} IS NULL) AS n_unknown FROM behavior_events GROUP BY 1"
