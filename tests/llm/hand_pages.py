"""Pages of several kinds, written and labelled by hand: B is main body, C is anything else. They follow no composer."""

PAGES = [
    ("Bread with a long rise", """
C Recipes  Baking  Soups  Drinks
C You are here: Home > Baking > Bread
B Bread with a long rise
C by Anna K. | 14 comments
B This loaf takes almost no work, but it wants a whole night. My grandmother made it every Friday.
B Ingredients
B * 500 g flour
B * 350 ml water
B * 10 g salt
B * a pinch of yeast
B Mix everything in a bowl and cover it. After twelve hours the dough has doubled; fold it twice and let it rest again.
B Bake it at 240 degrees until the crust is dark. Don't open the oven in the first twenty minutes.
C Print recipe | Save | Share
C More bread recipes
C Rye rolls in an hour
C The best flour for pizza
C Sign up and get one recipe a week
C Imprint | Privacy | Contact
C (c) 2019 Kitchen Notes
"""),
    ("Warum läuft mein Skript nicht?", """
C Forum
C Registrieren
C Suchen
B Warum läuft mein Skript nicht?
C Verfasst von peter81 am 3. März 2021, 18:04
B Hallo, ich habe seit gestern ein Problem mit meinem Skript. Es bricht nach zwei Zeilen ab und meldet keinen Fehler.
B     for i in liste:
B         print(i)
B Was mache ich falsch?
C Zitieren | Melden
C Verfasst von moni am 3. März 2021, 19:20
B Wahrscheinlich ist deine Liste leer. Gib sie vorher einmal aus, dann siehst du es sofort.
C Zitieren | Melden
C Seite 1 von 1
C Ähnliche Themen
C - Skript zu langsam
C - Liste sortieren
C Alle Zeiten sind UTC.
C Datenschutz · Nutzungsbedingungen · Team
"""),
    ("城市图书馆延长开放时间", """
C 首页 | 新闻 | 体育 | 财经
C 当前位置：首页 > 新闻 > 本地
B 城市图书馆延长开放时间
C 2022年5月6日 来源：本报 编辑：小李
B 从下周一起，城市图书馆每天开放到晚上十点，周末也不例外。馆长表示，这是应读者的要求作出的决定。
B 图书馆去年接待了四十多万名读者，其中一半以上是学生。新的开放时间将试行三个月。
B 读者可以在网上预约座位，也可以到服务台登记。
C 分享到：
C 相关新闻
C 博物馆免费开放
C 新地铁线路开通
C 网友评论（12）
C 关于本站 | 广告服务 | 联系我们
C 沪ICP备000000号
"""),
    ("parse_date", """
C Toolkit 2.4 documentation
C Search docs
C GETTING STARTED
C Installation
C Tutorial
B # parse_date
B Reads a date from text and returns it as a day of the calendar.
B | name | meaning |
B |------|---------|
B | text | what is read |
B | zone | where the clock runs |
B Raises an error if the text holds no date. Two dates in one text are an error as well.
B ## Example
B     parse_date("3 May 2020")
B ## See also
B The function format_date does the reverse.
C Next
C Previous
C Built with Sphinx
C Edit on GitHub
"""),
    ("River levels fall again", """
C MENU
C Weather  Sport  Business  Travel
C Subscribe from 2 a week
B River levels fall again
C Published 12 hours ago
C Share
B Levels in the two largest rivers have fallen for the third week in a row, the water authority said on Tuesday.
B Farmers were told to water only at night. "We have not seen this in forty years," one of them said.
C ADVERTISEMENT
B The authority expects rain in the second half of the month, but it warned that a few days would not be enough.
B Ships are carrying half of their usual load, and prices for freight have doubled since June.
C Related Topics
C Drought
C Farming
C Top Stories
C Minister resigns over budget
C Storm closes two airports
C Terms of Use
C Cookies
C Accept all cookies   Manage settings
"""),
    ("How do I keep tomatoes over winter?", """
C Questions Tags Users Unanswered
B How do I keep tomatoes over winter?
C Asked 4 years ago   Viewed 2k times
B I have more tomatoes than I can eat. Freezing made them watery, and I have no cellar.
C 3
C Add a comment
B Dry them. Cut them in half, salt them a little and leave them in the oven at 80 degrees for a night.
B In a closed glass with oil they keep for half a year.
C answered May 4 at 10:12
C Not the answer you're looking for? Browse other questions tagged vegetables storage
C Linked
C Can I freeze peppers?
C Company
C Contact
C Privacy Policy
C site design / logo; user contributions licensed
"""),
]


def labelled() -> list[tuple[str, str, set[int]]]:
    """(title, text, numbers of the lines outside the main body) of each page."""
    out = []
    for title, body in PAGES:
        lines = body.strip("\n").split("\n")
        out.append((title, "\n".join(line[2:] for line in lines), {n for n, line in enumerate(lines, 1) if line[0] == "C"}))
    return out
