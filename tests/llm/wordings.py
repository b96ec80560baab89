"""Segments labelled by hand: residue in wordings that no phrase of the weak labels has, and clean twins of them."""

RESIDUE = """
Internal Server Error
Bad Gateway
HTTP Error 500
Forbidden
[Company Name]
Insert text here
TODO: write this section
Sie haben keinen Zugriff auf dieses Dokument.
Unfortunately the page you wanted could not be delivered.
We were unable to fetch this report, try reloading.
The attachment you requested no longer exists on this server.
Please turn scripting on in your settings and refresh.
This application will not run unless JavaScript is active.
Your access to this workspace has ended, please log in again.
Sorry, that file is gone.
Dear [Customer Name],
Sincerely, <your signature>
Invoice {{invoice_id}} of {date} is enclosed.
The meeting on XXXX takes place in the office.
Add your introduction here
Your subtitle here
Lorem ipsum dolor sit amet, sed do eiusmod
Die gewünschte Seite existiert nicht.
Bitte schalten Sie JavaScript ein.
Leider konnte die Datei nicht geladen werden.
Sehr geehrte Frau [Nachname],
该链接已经过期。
请先开启 JavaScript 再访问。
抱歉，您没有查看权限。
尊敬的{{客户姓名}}：
在此处输入标题
""".strip().split("\n")

CLEAN = """
Internal audit and the server team met on Monday.
The gateway to the north campus was painted.
The error budget for May was 500 minutes.
Visitors are forbidden to smoke in the yard.
The name of the company was changed in March [see annex 2].
The signed page goes into the blue folder.
We have to write this section of the manual by Friday.
Die Gruppe erhielt am 3. Mai Zugriff auf das Dokument.
The page on travel costs was printed and delivered.
The report was fetched by the courier at noon.
The attachment lists the servers of both sites.
The scripts for the night job were tested last week.
The application for JavaScript training was approved.
Access to the workspace is granted by the owner.
The customer's name stands on page two.
The letter template has {{customer}} in it, and the mailer replaces it with the name.
Invoice 4417 of 3 May is enclosed.
The meeting on Tuesday takes place in the office.
The introduction was written by the lab.
The session of the board ended at noon.
The ticket was closed after the vendor had answered.
Users reported the text Page not found after the share had been renamed; the link works again.
Der Server im Keller wurde am Montag ersetzt.
Die Sitzung endete um zwölf Uhr, das Protokoll folgt.
Die Datei enthält die Namen der Zuständigen.
Frau Adler leitet die Gruppe seit Mai.
该链接列在手册第三页。
服务器于周一更换，权限表已更新。
请在周五之前提交脚本清单。
客户姓名和地址登记在档案中。
标题由编辑在周三改过。
""".strip().split("\n")
