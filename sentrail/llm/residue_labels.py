"""Weak labels and seed wordings for the classifier of residue (residue.py); used in training only.

A segment is labelled residue by status lines, general wording of error and access pages, filler and
placeholder notations; a segment that quotes, explains or reports such things is labelled clean. Seeds are
short texts in general use, and placeholders set at random into clean segments of the sample, so that the
classifier also learns wordings that stand in no sample.
"""

from __future__ import annotations

import http
import re
from collections.abc import Iterator

import numpy as np

# Notations of unfilled placeholders; X stands for the field's name.
NOTATIONS = (
    "{{X}}", "{{ X }}", "{X}", "${X}", "<%= X %>", "{% if X %}", "%(X)s", "%%X%%", "@@X@@", "<<X>>", "«X»", "[[X]]", "__X__", "[X]", "#X#", "$X$", "&lt;X&gt;", "{{ doc.X | upper }}", "XXXX", "XXXXXX", "××××",
    "[insert X here]", "<your X>", "<enter X>", "(X to be supplied)", "[X TBD]", "[your X]", "(X TBC)", "<insert X>", "[X hier einfügen]", "(X folgt)", "[bitte X ergänzen]", "<X eintragen>", "[X待补充]", "［X待填］", "【请填写X】", "（此处插入X）", "(X待定)",
)
# Names of fields that forms and letters leave open.
FIELDS = (
    "name", "Company Name", "company", "date", "due_date", "DATE", "amount", "AMOUNT", "recipient", "RECIPIENT", "project", "ProjectName", "project-title", "address", "title", "department", "phone number", "reference", "ORDER_NO", "client.name", "user_email", "signature", "owner", "site", "reviewer", "city", "start date", "contract_no", "link",
    "Datum", "Betrag", "Empfänger", "EMPFÄNGER", "Projekt", "Abteilung", "Firma", "Anschrift", "Ansprechpartner", "Vorname", "日期", "金额", "收件人", "项目名称", "部门", "姓名", "公司名称", "合同编号", "负责人", "地址", "电话",
)
# Error, access and script messages in general use.
MESSAGES = (
    "An error has occurred.", "An unexpected error occurred.", "Something went wrong.", "Sorry, something went wrong on our side.", "Access denied.", "Permission denied.", "You do not have access to this page.", "You don't have permission to view this file.", "You are not authorized to open this document.", "You need permission.", "Missing rights to open this folder.", "Request access.", "Ask the owner for access.", "Contact your administrator.", "Please contact support.",
    "Page not found.", "File not found.", "This page does not exist.", "The page you are looking for does not exist.", "The requested page could not be found.", "We can't find the page you asked for.", "The document has been moved or deleted.", "This link has expired.", "The link is no longer valid.", "It may have been removed.", "This content is not available.", "This page can't be displayed.", "This site can't be reached.", "The file could not be opened.", "The view failed to load.", "Unable to load the document.", "Preview is not available.", "Download the file to view it.", "Nothing to see here.", "There is nothing here.",
    "Your session has expired.", "Your session timed out.", "Your ticket is no longer valid.", "Please sign in again.", "Sign in to continue.", "Log in to view this page.", "Authentication required.", "Too many requests.", "Too many attempts from your address.", "Slow down.", "Please try again later.", "Try later.", "Come back later.", "Please retry.", "Wait 30 seconds and reload.",
    "The server did not respond.", "The server took too long to answer.", "The server is under maintenance.", "The service is unavailable.", "The connection was closed.", "The connection has timed out.", "Could not connect to the server.", "Could not connect to the database.", "Your request could not be completed.", "We could not process your request.", "Oops!", "Oh no!", "Traceback (most recent call last):", 'File "/app/main.py", line 10, in run', "ValueError: bad value", "NullPointerException: null", "ERR_CONNECTION_REFUSED", '{"error":"not_found","status":404}', '{"message": "Your token expired.", "code": 401}', '{"detail": "Not authenticated."}', "<Error><Code>NoSuchKey</Code></Error>", "<title>404 Not Found</title>",
    "Please enable JavaScript.", "You need to enable JavaScript to run this app.", "JavaScript is required.", "JavaScript is disabled in your browser.", "This site requires scripts.", "This app does not work without JavaScript.", "Scripts must be on.", "Cookies must be enabled.", "Allow scripts and reload the page.", "Your browser blocks scripts.", "Your browser does not support JavaScript.", "Your browser is out of date.", "If nothing happens, allow scripts.", "<noscript>Turn on scripts to use this site.</noscript>", "Checking your browser.", "Loading...", "Loading, please wait.", "One moment please.", "Please wait while the page loads.", "This takes a few seconds.",
    "Ein Fehler ist aufgetreten.", "Seite nicht gefunden.", "Die Seite wurde nicht gefunden.", "Die Datei kann nicht geöffnet werden.", "Der Inhalt kann nicht angezeigt werden.", "Zugriff verweigert.", "Keine Berechtigung.", "Sie haben keine Rechte für diese Datei.", "Fehlende Rechte.", "Ihre Sitzung ist abgelaufen.", "Der Link ist abgelaufen.", "Die Freigabe wurde beendet.", "Dieser Link gilt nicht mehr.", "Bitte melden Sie sich erneut an.", "Bitte neu anmelden.", "Bitte später erneut versuchen.", "Bitte versuchen Sie es später noch einmal.", "Zu viele Anfragen.", "Der Server antwortet nicht.", "Der Server ist überlastet.", "Der Dienst wird gewartet.", "Der Dienst ist nicht erreichbar.", "Bitte aktivieren Sie JavaScript.", "Bitte erlauben Sie Skripte.", "Diese Seite benötigt JavaScript.", "Ihr Browser unterstützt keine Skripte.", "Ihr Browser blockiert Skripte.", "Einen Moment bitte.", "Wird geladen ...", "Die Vorschau ist nicht verfügbar.",
    "页面不存在。", "文件不存在。", "抱歉，您访问的页面不存在。", "您没有权限查看此页面。", "您无权访问该文件。", "没有权限，请联系管理员。", "请先登录。", "登录已过期，请重新登录。", "会话已超时，请重新登录。", "链接已失效。", "分享已过期，请联系分享人。", "请求过于频繁，请稍后再试。", "操作过于频繁，请稍候。", "服务器正在维护，请稍后重试。", "服务器错误。", "系统繁忙，请稍后再试。", "连接超时，请稍后重试。", "无法显示此页面。", "无法打开文件。", "加载失败。", "预览失败，请下载原文件。", "转换出错。", "文件已被移除。", "返回空结果，错误码500。", "请启用JavaScript。", "请开启脚本后刷新页面。", "您的浏览器不支持脚本。", "当前浏览器禁用了脚本。", "请允许脚本运行。", "加载中……", "请稍候。", "正在检测浏览器。",
)
# Parts of messages, joined at random: who, what failed, when; what to switch on, for what.
WHO = ("The page", "This page", "The site", "This site", "The file", "This file", "Requested file", "The requested page", "The document", "Your document", "The preview", "The view", "This view", "The content", "The portal", "The viewer", "The resource you asked for", "The document you requested", "We're sorry but the app")
FAILED = ("could not be loaded", "could not be opened", "could not be found", "cannot be displayed", "cannot be shown", "can't be rendered", "was not found", "was not loaded", "is not available", "is unavailable", "failed to load", "failed to open", "failed to be displayed", "does not exist", "has been moved", "has been removed", "has been deleted", "is gone", "doesn't work properly", "doesn't work with scripts disabled", "does not work properly without scripts", "has stopped working")
PASS = ("Your session", "The session", "Your login", "Your token", "Your ticket", "Your link", "This link", "The share", "The address", "This address", "Your visit", "Your invitation")
ENDED = ("has expired", "has ended", "has run out", "timed out", "is no longer valid", "is not valid any more", "was withdrawn", "was revoked", "was closed", "has been closed", "has been moved", "is invalid")
HOST = ("The server", "The service", "The gateway", "The database", "The backend", "The host", "The proxy", "The store", "The upstream")
FELL = ("did not answer", "did not respond", "took too long", "closed the connection", "returned an empty reply", "is under maintenance", "is overloaded", "is down", "is unreachable", "cannot be reached", "reported an error")
WHEN = ("", "", "", "", " right now", " at this time", " at the moment", "!", ", please try again later", " or it may have moved")
SWITCH = ("Please enable", "Enable", "Please turn on", "You need to turn on", "Switch on", "Please switch on", "Please allow", "Allow", "Please activate", "You must activate", "This page needs", "This app requires", "This site does not work without", "The viewer stays empty without", "Your browser seems to lack", "Your browser does not support", "Your browser blocks", "Your browser has switched off", "This client does not support")
SCRIPTS = ("JavaScript", "JS", "scripts", "scripting", "active content", "cookies", "scripts and cookies", "Javascript")
GOAL = ("", "", " to continue", " to view this page", " to open this document", " before opening the file", " in your browser", " and reload", " to run this app", " in order to read this page")
LACK = ("Missing rights to view", "Missing rights for", "Insufficient rights for", "Insufficient permission to open", "No permission to open", "You are not authorized to view", "You are not allowed to open", "You do not have permission to access", "You don't have access to", "You lack the clearance for", "Access is denied to", "Sign in to open", "Log in again to view", "Authenticate again to open", "Request access to", "Ask the owner for", "We can't find", "Could not find", "Unable to load", "Cannot open")
OBJECT = ("this item", "this folder", "this page", "this document", "the file", "this resource", "that page", "the share")
WHO_DE = ("Die Seite", "Diese Seite", "Die Datei", "Das Dokument", "Der Inhalt", "Die Vorschau", "Die Ansicht", "Die angeforderte Datei")
FAILED_DE = ("konnte nicht geladen werden", "kann nicht angezeigt werden", "kann nicht dargestellt werden", "wurde nicht gefunden", "ist nicht verfügbar", "ist nicht mehr verfügbar", "lässt sich nicht öffnen", "existiert nicht", "wurde verschoben", "wurde entfernt")
PASS_DE = ("Ihre Sitzung", "Ihre Anmeldung", "Die Freigabe", "Der Link", "Diese Adresse", "Ihr Zugang")
ENDED_DE = ("ist abgelaufen", "wurde beendet", "wurde zurückgezogen", "gilt nicht mehr", "ist ungültig", "ist gesperrt")
LACK_DE = ("Fehlende Rechte für", "Keine Berechtigung für", "Sie haben keine Rechte für", "Sie haben keinen Zugang zu", "Zugriff verweigert auf", "Bitte neu anmelden für")
OBJECT_DE = ("diese Seite", "diese Datei", "dieses Dokument", "diesen Ordner", "den Inhalt")
HOST_DE, FELL_DE = ("Der Server", "Der Dienst", "Das Gateway", "Der Speicher", "Die Datenbank"), ("antwortet nicht", "ist überlastet", "ist nicht erreichbar", "wird gewartet", "meldet einen Fehler", "hat die Verbindung beendet")
SWITCH_DE = ("Bitte aktivieren Sie", "Bitte erlauben Sie", "Aktivieren Sie", "Diese Seite benötigt", "Die Anwendung läuft nur mit", "Ihr Browser blockiert", "Ihr Browser unterstützt kein", "Diese Anwendung braucht")
SCRIPTS_DE, GOAL_DE = ("JavaScript", "Skripte", "aktive Inhalte", "Cookies", "Skripte und Cookies"), ("", "", ", um diese Seite anzuzeigen", ", um fortzufahren", " und laden Sie neu", " im Browser")
LACK_ZH, OBJECT_ZH = ("您没有权限查看", "您无权访问", "没有权限打开", "您没有授权查看", "请登录后查看", "请申请访问"), ("该页面", "该文件", "此文档", "该文件夹", "本页")
HOST_ZH, FELL_ZH = ("服务器", "服务", "系统", "网关", "数据库", "存储服务"), ("没有响应", "正在维护", "繁忙", "连接超时", "返回错误", "返回空结果", "出错")
SWITCH_ZH, SCRIPTS_ZH, GOAL_ZH = ("请启用", "请开启", "请允许", "须先开启", "您的浏览器不支持", "您的浏览器未启用", "当前浏览器禁用了", "此页面需要"), ("脚本", "JavaScript", "JS", "Cookie", "脚本和Cookie"), ("", "后刷新页面", "以便使用此文档", "以继续访问", "，请更换浏览器", "，请开启后访问")
WHO_ZH = ("页面", "该页面", "文件", "所请求的文件", "此文档", "内容", "预览", "视图")
FAILED_ZH = ("不存在", "无法打开", "无法显示", "加载失败", "打开失败", "已被移除", "已被删除", "暂不可用", "无法访问")
PASS_ZH = ("会话", "您的会话", "登录", "令牌", "链接", "分享", "地址", "访问权限")
ENDED_ZH = ("已过期", "已失效", "已超时", "已撤回", "已结束", "无效")
THEN_ZH = ("", "", "，请重新登录", "，请稍后再试", "，请联系管理员", "，请返回上一页")
MESSAGE_PARTS = (
    (WHO, FAILED, WHEN), (PASS, ENDED, WHEN), (HOST, FELL, WHEN), (SWITCH, SCRIPTS, GOAL), (LACK, OBJECT, WHEN),
    (WHO_DE, FAILED_DE), (PASS_DE, ENDED_DE), (HOST_DE, FELL_DE), (SWITCH_DE, SCRIPTS_DE, GOAL_DE), (LACK_DE, OBJECT_DE),
    (WHO_ZH, FAILED_ZH, THEN_ZH), (PASS_ZH, ENDED_ZH, THEN_ZH), (HOST_ZH, FELL_ZH, THEN_ZH), (SWITCH_ZH, SCRIPTS_ZH, GOAL_ZH), (LACK_ZH, OBJECT_ZH),
)
# Parts of ordinary sentences with the same words, and remarks in brackets that belong to a text.
ORDINARY_WHO = ("The page", "The file", "The document", "The preview of the plan", "The view from the tower", "The content of the box", "The portal team", "The session of the council", "The link between both sites", "The share of the costs", "The address of the depot", "The ticket", "The server room", "The server", "The gateway to the yard", "The database of parts", "The service desk", "The store", "The script for the night job", "The browser test", "The request", "The owner of the file", "The administrator", "The permission slip", "The error budget", "The title", "The summary", "The name of the client", "The customer's name", "The date of the visit", "The amount", "The recipient", "The section on travel", "The cookies in the kitchen", "The message", "The login list", "The visitor", "The application for leave")
ORDINARY_DID = ("was discussed on Monday", "is described on page four", "was replaced in March", "lies in the blue folder", "was printed and sent by courier", "is forbidden in the yard", "was painted last week", "is kept by the archive", "was signed by both sides", "stands on the second page", "was approved by the board", "costs 40 crowns a month", "was tested before the audit", "ended at noon", "goes to the finance group on Friday", "was opened by the clerk at nine", "was closed after the vendor had answered", "has been moved to the new shelf", "is checked every week", "was changed by the editor", "answers most questions of new staff", "is needed for the contract", "was found in the drawer")
ORDINARY_WHO_DE = ("Die Seite", "Die Datei", "Das Dokument", "Der Inhalt der Kiste", "Die Sitzung des Rates", "Der Server im Keller", "Der Dienst am Sonntag", "Die Adresse der Firma", "Das Skript für den Lauf", "Der Browser im Testraum", "Der Titel", "Die Zusammenfassung", "Der Name des Kunden", "Der Zugang zum Hof", "Der Speicher der Anlage", "Die Freigabe des Plans")
ORDINARY_DID_DE = ("wurde am Montag besprochen", "steht auf Seite vier", "wurde im März ersetzt", "liegt in der blauen Mappe", "wurde von beiden Seiten unterschrieben", "enthält die Namen der Zuständigen", "endete um zwölf Uhr", "ist im Archiv verwahrt", "wurde am 3. Mai erteilt", "kostet 40 Kronen im Monat", "wird jede Woche geprüft", "wurde vor der Prüfung getestet")
ORDINARY_WHO_ZH = ("页面", "文件", "该文档", "会议", "服务器", "数据库", "链接", "地址", "脚本清单", "标题", "摘要", "客户姓名", "金额", "权限表", "登录记录", "浏览器测试", "合同编号", "系统")
ORDINARY_DID_ZH = ("于周一讨论过", "列在手册第三页", "三月已更换", "登记在档案中", "由双方签署", "中午结束", "每周检查一次", "由编辑修改过", "周五之前提交", "已更新并归档", "放在蓝色文件夹里", "经主管批准")
ORDINARY_PARTS = ((ORDINARY_WHO, ORDINARY_DID), (ORDINARY_WHO, ORDINARY_DID), (ORDINARY_WHO_DE, ORDINARY_DID_DE), (ORDINARY_WHO_ZH, ORDINARY_DID_ZH))
REMARKS = ("[see annex 2]", "[1]", "[sic]", "[page 4]", "(see below)", "[emphasis added]", "[Annex B]", "(in German)", "<info@example.org>", "[siehe Anlage 3]", "(vgl. Seite 2)", "[见附件二]", "（见下文）", "#12", "$40", "{a, b}", "50 %", "[draft]", "[approved]", "(Q3)")
# What stands before or after any line of a page, and how services wrap a message.
FURNITURE = ("Skip to content", "Home > Documents > report_7", "Home > Files >", "Menu Search Login", "Help | Contact | Imprint", "Terms | Privacy", "Startseite > Dateien >", "Suche Anmelden", "Impressum | Datenschutz", "首页 > 文档 >", "搜索 登录", "帮助 | 联系我们", "https://files.example.org/a/report_7", "https://intranet.example.net/start", "Reference 4f1c9a20", "12 March 2021, 08:15", "Error code 17")
WRAPPERS = ('{"error": "M", "status": 500}', '{"message": "M", "code": 403}', '{"detail": "M"}', "<noscript>M</noscript>", "<title>M</title>", "Sorry, M", "Sorry - M", "403 M", "Error: M", "M (504)")
# Filler and layout prompts in general use; X stands for a part of a page.
PROMPTS = (
    "Click to add X", "Click here to add X", "Type the X here", "Type the X in this box", "Enter your X here", "Insert X here", "Your X goes here.", "Your X here", "Replace this X with your own.", "Replace this paragraph with your own X.", "Add your X here", "This is sample X.", "This is placeholder X for layout only.", "Sample X, to be replaced.", "Dummy X", "Dummy X, to be written later.", "Placeholder X", "Second level X", "TODO: write the X", "TBD: X", "X goes here", "[X]",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", "Ut enim ad minim veniam, quis nostrud exercitation.", "Hier steht später X.", "Hier X einfügen", "Hier klicken, um X hinzuzufügen", "Bitte X durch eigenen Text ersetzen.", "Dies ist nur ein Blindtext für X.", "Platzhalter für X", "Mustertext für X", "单击此处添加X", "点击添加X", "此处输入X", "在此输入X", "占位内容，X稍后补写。", "这里是X示例文字，请替换。", "X占位符", "示例X，请替换。",
)
# Parts of a page.
PARTS = ("title", "text", "content", "summary", "caption", "subtitle", "conclusion", "heading", "description", "body text", "der Titel", "der Text", "der Inhalt", "die Zusammenfassung", "标题", "正文", "摘要", "内容", "结论")
# Sentences that quote, explain or report; P stands for a placeholder, M for a message.
FRAMES = (
    "The form uses P as a mark that the system fills in before sending.", "Every letter template has P in it, and the mail tool replaces it with the value.", "Authors write P in the source and the build puts the real value there.", "The old program marked open fields as P; none of them is left.", "The manual explains that P stands for the value of the field.", "In the config file, P is expanded when the service starts.", "Write P where the value should go, as the guide says.", "Set PATH=${HOME}/bin before you run the tool.", "Run export DATA_DIR=${HOME}/data before the first start.", "Copy the file to %APPDATA%\\tool\\config.ini first.", "SELECT name, path FROM files WHERE action = 'copy'", "rule match_name { strings: $a = \"report\" condition: $a }",
    'The page showed the message "M" until the link was mended.', 'The guide quotes "M" as an example for new staff.', 'Slide 4 shows the text "M" so that readers know what it means.', "Two users reported the text M after the folder was moved; it works again.", "During the test the server answered M for ten minutes, and no data was lost.", "Readers who had asked for the old address saw M until the index had been rebuilt.", "The log that said M was sent to the vendor and led to a patch.", "M was the right reply, since the group had not asked for rights.", "We switched off scripts on purpose, and the page then asked the tester to allow them, as planned.", "The first sketch used filler text, which was replaced before it went out.", "The first draft of the poster held blind text for layout; the final one has none.",
    "Die Vorlage enthält P, das beim Versand durch den Wert ersetzt wird.", "Das alte Programm schrieb P an offene Stellen; davon ist nichts geblieben.", "Der Hinweis „M“ erschien, nachdem der Ordner umbenannt worden war; der Link stimmt wieder.", "Die Folie zeigt den Text „M“ als Beispiel für neue Kollegen.", "Beim Test meldete der Server zehn Minuten lang M, danach lief alles wieder.", "Im ersten Entwurf stand ein Blindtext, der vor dem Druck ersetzt wurde.",
    "模板中的P由系统在发送前自动替换，已检查。", "旧程序用P标记空缺，现在已全部补齐。", "目录移动后曾出现“M”的提示，链接已修好。", "培训材料以“M”为例说明提示的含义。", "测试期间服务器返回M共十分钟，没有丢失数据。", "测试时关闭了脚本，页面按设计提示读者开启脚本。", "初稿曾使用占位文字，定稿前已替换。",
)
# Words of the usual blind text.
BLIND_TEXT = frozenset("lorem ipsum dolor amet elit magna aliqua veniam quis enim minim labore tempor incididunt adipiscing consectetur sit sed nostrud eiusmod".split())

PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%{}\n]{1,60}%\}|<%=?[^%\n]{1,60}%>|\$\{[^{}\n]{1,60}\}|%%[^%\n]{1,40}%%|@@[^@\n]{1,40}@@|<<[^<>\n]{1,40}>>|«[^«»\n]{1,40}»|\[\[[^\[\]\n]{1,40}\]\]|%\([^()\n]{1,40}\)[sd]|&lt;[^&\n]{1,40}&gt;|×{3,}|(?<![A-Za-z])X{4,}(?![A-Za-z])"
    r"|#(?:[A-ZÄÖÜ][\w. \-]{2,30}|[\w.]{0,8}[一-鿿]{2,8}\d?)#|__(?:[A-ZÄÖÜ][\w.\- ]{1,40}|[\w.]{0,8}[一-鿿]{2,8}\d?)__|\$(?:[A-ZÄÖÜ][A-ZÄÖÜ._ \-]{2,30}\d?|[\w.]{0,8}[一-鿿]{2,8}\d?)\$|\[(?:[A-ZÄÖÜ][A-ZÄÖÜ._ \-]{2,30}\d?|[一-鿿]{2,8}\d?)\]|(?<!\$)\{[A-Za-zÄÖÜ一-鿿][\w.\-]{1,30}\}"
    r"|[\[(<](?i:insert|enter|your|tbd|todo|fill|bitte|hier|ihr)\b[^\[\]()<>\n]{1,50}[\])>]|[\[(][\w \-.]{2,40}\b(?:to be (?:supplied|added|confirmed|filled in)|tbd|tbc|ergänzen|einsetzen|einfügen|eintragen|folgt|nachtragen)[\])]|[［\[(（【][^\[\]［］()（）【】\n]{0,12}(?:待补|待填|待定|请填写|此处插入)[^\[\]［］()（）【】\n]{0,12}[］\])）】]"
)
_REASONS = "|".join(sorted(re.escape(s.phrase.lower()) for s in http.HTTPStatus if s >= 400))
_THING = r"(?:page|site|file|document|link|address|content|resource|preview|view|session|login|token|ticket|share|request|folder|viewer|app)"
ERROR = re.compile(
    rf"\b[45]\d\d[ :\-]{{1,3}}(?:{_REASONS})\b|^(?:{_REASONS})\W*$|^http error \d|<title>|<noscript>|<error>|^traceback \(most|^[a-z]*(?:error|exception):|^\s*file \"/|\"(?:error|detail|reason|message)\": ?\"|\berr_[a-z_]+"
    r"|access (?:is |was |has been )?denied|permission (?:denied|to (?:view|open|access))|(?:missing|insufficient|no|lack of) (?:rights|permission|clearance)|not authori[sz]ed to|(?:don't|do not|does not) have (?:the )?(?:rights|permission|clearance|access)|contact (?:your|the) administrator|^request access"
    r"|(?:can't|cannot|can not|couldn't|could not|unable to|failed to) (?:be )?(?:find|found|connect|reach(?:ed)?|load(?:ed)?|open(?:ed)?|display(?:ed)?|shown|render(?:ed)?|retrieved?|complete)"
    rf"|\b{_THING}\b.{{0,30}}\b(?:not found|is not available|(?:was|were) not (?:opened|retrieved|loaded|rendered|displayed|found)|no longer valid|not valid any more|does not exist|has expired|has run out|timed out|has ended|has moved|(?:was|has been) (?:withdrawn|revoked|closed|moved|removed)\W*$)"
    r"|something went wrong|^oops|an error (?:has )?occurred|(?:sign|log) in (?:again|once more|to (?:open|go|view|continue))|^authenticate|too many (?:requests|attempts)|^slow down|^come back later|^(?:please )?(?:try|retry)\b.{0,12}(?:later)?\W*$|^try again later|^wait \d+ seconds"
    r"|(?:server|service|gateway|database|backend|relay|store|upstream) (?:did not (?:answer|respond)|took too long|returned an empty|closed the connection|is (?:unavailable|overloaded|under maintenance))|under maintenance"
    r"|(?:enable|activate|allow|turn on|switch on|needs?|requires?|without|lacks?|supports?|blocks?) (?:java ?script|js\b|scripts?\b|scripting|cookies|active content)|(?:java ?script|js|scripts?|scripting|cookies)(?: and \w+)? (?:must be|is|are) (?:on|needed|required|disabled|off|allowed)|(?:java ?script|scripts?|scripting|cookies) (?:disabled|switched off|turned off)|check(?:ing)? (?:your|the) browser|browser (?:does not|is not|is out of|in use|blocks)|^loading\b|^one moment|^please wait"
    r"|ist abgelaufen\.|lässt sich nicht (?:öffnen|laden|anzeigen)|(?:sitzung|anmeldung|freigabe|link|adresse) (?:wurde (?:beendet|zurückgezogen|entzogen)|gilt nicht)|wird gewartet|fehlende rechte|keine (?:berechtigung|rechte)|neu anmelden|überlastet|melden sie sich|später erneut|browser (?:blockiert|unterstützt)|(?:aktivieren|erlauben) sie|benötigt (?:javascript|skripte)|läuft nur mit|nicht (?:dargestellt|geladen|gefunden|angezeigt|geöffnet) werden|antwortet nicht|nicht erreichbar|zugriff verweigert|zu viele anfragen|(?:seite|datei|dokument|vorschau|inhalt)\b.{0,30} nicht (?:mehr )?(?:gefunden|verfügbar|gültig)"
    r"|(?:预览|加载|打开)失败|转换出错|没有(?:权限|授权)|无权|请(?:重新|先)?登录|(?:会话|登录|令牌|链接|地址|页面|分享|连接)已?(?:超时|过期|失效|撤回)|请稍[候后]|请联系(?:管理员|分享人)|不支持脚本|未启用脚本|禁用了?脚本|(?:开启|允许|启用|运行) ?(?:脚本|js|cookie)|检测到?浏览器|浏览器版本|(?:页面|文件|内容)不存在|(?:请求|操作)过于频繁|错误码|正在维护|系统繁忙|^加载中|无法(?:显示|打开|加载|访问|连接)|已被(?:移除|删除)|空结果"
)
FILLER = re.compile(
    r"click (?:here )?to add|^(?:[•*\-] )?second level \w+\W*$|your \w+ goes here|replace this (?:paragraph|text)|(?:type|insert|enter) (?:the |your )?\w+ (?:in this box|here)|^dummy \w+|this is (?:sample|placeholder|dummy) \w+|hier steht später|durch eigenen text ersetzen|nur ein blindtext|(?:此处|点击|单击此处)(?:输入|添加)|^占位内容|示例文字，请替换|^todo\b"
)
# Sentences that quote, explain or report: talk of templates and what fills them, code, the past of an error.
_EXPLAIN = re.compile(
    r"\b(?:templates?|macros?|editors?|authors?|writers?|tool|program|loader|compiler|renderer|mailer|parser|form in use)\b.*\b(?:replaces?|fills?|filled|inserts?|sets?|swaps?|marked|marks?|puts?|writes?|uses?|contains?|carries|holds|has|rejects|drops|refuses)\b|(?:vorlage|werkzeug|programm)\w*\b.*\b(?:enthält|ersetzt|schrieb)|(?:模板|工具|程序).*(?:替换|标记|用)"
    r"|\bexport [a-z_]+=|\bset [a-z_]+=|%[a-z]+%\\|\bselect\b[^.]*\bfrom\s+(?!(?:the|your|our|this|that|these|those|a|an|its|their)\b)[\w.\"`]+|^rule \w+ \{"
)
_REPORT = re.compile(
    r"\bhad\b|\bthen (?:told|tells|asks|asked)\b|\b(?:quotes?|shows?|prints?|said|met|saw|reported|answered|returned|gave|replied|sent)\b.*\b(?:for \d+|after|so that|as an example|and)\b|\b(?:hinweis|folie|handbuch)\b|minuten lang|\d+ minuten\b|\b(?:mock-?up|sketch|first draft|entwurf)\b|按设计|曾出现|作为示例|为例|返回\d+共|初稿"
)
_QUOTED = re.compile(r"[\"“„「『][^\"“”„「」『』]{2,90}[\"”“」』]")


def _speaks(s: str) -> bool:
    """Whether the segment has the wording of a message or filler."""
    low = s.lower()
    words = low.split()
    if len(words) >= 4 and (any(a == b == c for a, b, c in zip(words, words[1:], words[2:])) or words[:4] == words[2:6] or sum(w.strip(".,") in BLIND_TEXT for w in words) * 4 >= len(words)):
        return True
    return bool(ERROR.search(low) or FILLER.search(low))


def weak_label(segment: str) -> bool:
    """Whether phrases or notations of residue stand in the segment, and nothing says they are only quoted."""
    s = segment.strip()
    low = s.lower()
    if PLACEHOLDER.search(s) and not _EXPLAIN.search(low):
        return s[0] in "{[<" or bool(PLACEHOLDER.search(_QUOTED.sub(" ", s)))
    if not _speaks(s) or _EXPLAIN.search(low) or _REPORT.search(low):
        return False
    return s[0] in "{[<" or _speaks(_QUOTED.sub(" ", s))


def _put(text: str, letter: str, value: str) -> str:
    return re.sub(rf"(?<![A-Za-z]){letter}(?![A-Za-z])", lambda _: value, text)


def seeds(clean: list[str], rng: np.random.Generator, n: int) -> Iterator[tuple[str, bool]]:
    """Segments with labels: status lines, messages, prompts, frames, and n clean segments (some in capitals, and pieces of them) with and without a placeholder set in."""

    def pick(values: tuple[str, ...] | list[str]) -> str:
        return values[rng.integers(len(values))]

    def mark() -> str:
        return _put(pick(NOTATIONS), "X", pick(FIELDS)) if rng.random() < 0.7 else _put(pick(NOTATIONS), "X", f"{pick(FIELDS)}{rng.integers(1, 10)}")

    def message() -> str:
        parts = MESSAGE_PARTS[rng.integers(len(MESSAGE_PARTS))]
        cjk = parts[0][0] > "一"
        return ("" if cjk else " ").join(pick(p).strip() for p in parts).replace(" !", "!").replace(" ,", ",").strip()

    bare = [m.rstrip(".。!") for m in MESSAGES if len(m) < 60 and m[0] not in '{<"']
    for _ in range(n // 2):
        parts = ORDINARY_PARTS[rng.integers(len(ORDINARY_PARTS))]
        yield ("" if parts[0][0] > "一" else " ").join(map(pick, parts)) + str(rng.choice(["", ".", "。"])), False
        m, r = pick(bare) if rng.random() < 0.2 else message(), rng.random()
        m = _put(pick(WRAPPERS), "M", m) if r < 0.15 else f"{pick(FURNITURE)} {m}" if r < 0.3 else f"{m}. {pick(FURNITURE)}" if r < 0.35 else m
        yield m + str(rng.choice(["", ".", "。"])), True
    for s in http.HTTPStatus:
        if s >= 400:
            yield from ((t, True) for t in (s.phrase, f"{s.value} {s.phrase}", f"HTTP Error {s.value}", f"Error {s.value}: {s.phrase}", f"HTTP {s.value} {s.phrase}.") * 3)
    for m in MESSAGES:
        yield from ((m, True), (m.rstrip(".。"), True), (m.lower(), True))
    for p in PROMPTS:
        yield from ((_put(p, "X", x), True) for x in PARTS if x.isascii() == p.isascii() or not p.isascii())
    for s in NOTATIONS:
        yield from ((_put(s, "X", FIELDS[i]), True) for i in rng.choice(len(FIELDS), 8, replace=False))
    for f in FRAMES:
        for _ in range(12):
            yield _put(_put(f, "P", mark()), "M", pick(bare) if rng.random() < 0.5 else message()), False
    for i in rng.choice(len(clean), min(n, len(clean)), replace=False) if clean else ():
        spaced = " " in clean[i]
        words = clean[i].split(" ") if spaced else list(clean[i])
        at, skip = int(rng.integers(len(words) + 1)), int(rng.integers(2))
        r = rng.random()
        yield clean[i].upper() if r < 0.1 else f"{pick(FURNITURE)} {clean[i]}" if r < 0.2 else clean[i], False
        if rng.random() < 0.15:
            yield (" " if spaced else "").join([*words[:at], pick(REMARKS), *words[at:]]), False
        if len(words) > 6:
            yield (" " if spaced else "").join(words[at : at + int(rng.integers(2, 7))]) or words[0], False
        yield (" " if spaced else "").join([*words[:at], mark(), *words[at + skip :]]), True
