"""Labelled pages for the boilerplate model: composed line by line from phrases, each line with its label.

The phrases are in English, German and Chinese and are such as any site has; none was taken from the tables.
``{n}`` is a number, ``{name}`` a product, ``{noun}`` and ``{adj}`` words. A seed and a number of pages fix the
sample, so every process trains the same model.
"""

from __future__ import annotations

import random

BODY, MENU, TEASER, NOTICE = 0, 1, 2, 3

#: Entries of menus, by language.
MENUS = {
    "en": "Home Products Solutions Shop News Events Help Jobs Team Press Services Partners Register Tutorials Gallery Archive Topics Blog Contact Login Account Basket Wiki API Docs Videos Sponsors FAQ Company Legal".split(),
    "de": "Startseite Produkte Leistungen Aktuelles Termine Hilfe Karriere Presse Kontakt Anmelden Konto Warenkorb Themen Archiv Verein Galerie Mitglieder Shop".split(),
    "zh": "首页 产品 方案 新闻 活动 帮助 团队 服务 会员 注册 教程 图库 专题 联系我们 登录 商城 视频 招聘 问答 公司".split(),
}
#: Headings above links to other pages.
TEASER_HEADS = {
    "en": ["Read next", "More stories", "Related posts", "Related content", "Editor's picks", "Recommended reading", "You might be interested in", "Other articles", "What others are reading", "More on this topic", "From our archive", "Hot right now", "Similar questions", "Readers also liked"],
    "de": ["Lesen Sie auch", "Ähnliche Artikel", "Passend dazu", "Weiterlesen", "Beliebte Themen", "Empfehlungen der Redaktion", "Auch interessant"],
    "zh": ["推荐阅读", "相关文章", "延伸阅读", "更多内容", "编辑推荐", "热点", "看了又看"],
}
#: Consent notices, page tools, counters and footers.
NOTICES = {
    "en": [
        "We use cookies to personalise content and to analyse our traffic. OK", "By using our website you agree to our cookie policy.", "Cookie preferences: essential, analytics, marketing. Save my choice",
        "{name} and selected third parties use cookies or similar technologies for technical purposes. Reject all | Agree", "Your choices regarding cookies on this site. Decline · Accept", "We care about your data. Manage {n} vendors",
        "To give you the best experience, we store and access information on your device. Deny | View preferences", "This page uses tracking for {adj} statistics.",
        "Get our best {noun} stories delivered to your mailbox every week.", "Stay up to date with {name}: enter your e-mail address", "Over {n} people already read our newsletter.", "Be the first to know about {adj} {noun}s. Sign me up",
        "Follow {name} on social media", "Like what you see? Subscribe", "Don't miss the next {noun} update", "Support independent writing: donate", "Become a member for more {noun} reports",
        "Copyright © {year} {name} Ltd. All rights reserved.", "© {year} {name}", "(c) {year}-{year} {name} Inc.", "{name} GmbH, registered office: {n} Station Road, company no. {n}", "{name} is a trademark of its owner.", "All product names are property of their respective holders.",
        "Powered by {name}", "Proudly hosted by {name} {v}", "Generated in {d}.{d}{d} seconds", "Version {v}, build {n}", "Server time: {day} {month} {year}", "Site map | Legal notice | Data protection", "Legal · Security · Cookies · Brand", "Terms & Conditions", "Privacy notice", "Imprint",
        "Scroll to top", "Top of page", "Skip navigation", "Open menu", "Close", "Dark mode", "Loading comments...", "Advertisement", "Sponsored content", "Continue reading below",
        "Older posts", "Newer posts →", "← Back", "Next chapter: {name} {v}", "Improve this page", "View source", "Flag as inappropriate", "Write a reply", "Join the discussion", "Comments are closed.",
        "Share: Facebook | Mail | Link", "Tweet this", "Print", "Save for later", "Did this answer your question? Yes / No", "Rate this article", "JavaScript is required for this feature.", "Please enable JavaScript to continue.", "My account | Sign out", "Choose your language: English",
        "[Logo]", "{n} views", "{n} views, {n} replies", "{d} minutes to read · {n} shares", "Upvote ({n}) · Answer", "{n} people found this useful", "Posted by member{n} on {month} {day}, {year}", "Last modified {day} {month} {year} by editor{n}", "Reading time: {d} min",
        "Keywords: {noun}, {noun}, {adj} {noun}", "Category: {noun}", "Topics: {adj} {noun} · {noun}", "Page {d} / {n}", "{d} of {n} results",
    ],
    "de": [
        "Wir verwenden Cookies, um Inhalte zu personalisieren. Ablehnen | Zustimmen", "Um unser Angebot zu verbessern, speichern wir Daten auf Ihrem Gerät.", "Ihre Auswahl zu Cookies und {n} Partnern können Sie jederzeit ändern.",
        "Newsletter bestellen", "Bleiben Sie mit {name} auf dem Laufenden", "Schon {n} Leserinnen und Leser beziehen unsere Post.", "Copyright {year} {name} GmbH. Alle Rechte vorbehalten.", "© {year} {name}", "Rechtliches | AGB | Datenschutzerklärung", "Impressum",
        "Zum Seitenanfang", "Navigation überspringen", "Menü öffnen", "Werbung", "Artikel drucken", "Seite {d} von {n}", "Weitersagen: Mail · Link", "Antwort verfassen", "Ältere Beiträge", "Neuere Beiträge →", "{n} Mal gelesen", "{n} Kommentare", "Zuletzt bearbeitet am {day}.{d}.{year} von Mitglied{n}",
        "Stichwörter: {noun}, {noun}", "Rubrik: {noun}", "Hat Ihnen das geholfen? Ja / Nein", "Bitte aktivieren Sie JavaScript.", "Sprache wählen: Deutsch",
    ],
    "zh": [
        "我们使用 Cookie 为您提供更好的服务。拒绝 | 同意", "为了统计访问量，本站会在您的设备上保存信息。", "您可以在设置中管理 {n} 项 Cookie。", "订阅我们的邮件，不错过{adj}{noun}", "加入会员，查看更多{noun}报告", "关注我们的微博", "手机扫一扫继续阅读",
        "Copyright © {year} {name} 有限公司", "© {year} {name} 保留一切权利", "京ICP备{n}号", "公网安备 {n} 号", "法律声明 · 隐私条款 · 网站导航", "隐私政策", "回到顶部", "打开菜单", "推广", "打印本页", "第 {d} 页，共 {n} 页", "收藏 | 转发 | 打印", "写评论", "查看全部评论", "上一章", "下一章 →",
        "浏览 {n} 次", "{n} 人阅读 · {n} 条回复", "赞同 {n} · 回答", "作者：会员{n} 发布于 {year}年{d}月{day}日", "最后修改：{year}-{d}-{day}", "关键词：{noun}，{noun}", "分类：{noun}", "这篇文章有用吗？有用 / 没用", "请开启 JavaScript。", "选择语言：中文",
    ],
}
#: Headings of a main body that speak of the same things as menus and notices do.
DECOYS = {
    "en": ["Signing in", "How search works", "Cookie handling", "Privacy considerations", "Setting up contact forms", "Download and install", "Navigation", "About this guide", "Getting help with the {noun}", "Status and error codes", "Terms and definitions", "Comments and white space", "Registering a {noun}", "Menus of the {noun}", "Account limits", "Forum software compared"],
    "de": ["Anmeldung am {noun}", "Wie die Suche arbeitet", "Umgang mit Cookies", "Datenschutz im {noun}", "Kontaktformulare einrichten", "Begriffe", "Hilfe zum {noun}"],
    "zh": ["如何登录", "搜索的原理", "Cookie 的处理", "隐私方面的考虑", "下载与安装", "术语和定义", "错误码说明", "{noun}的菜单"],
}
#: Headings of a main body that come again on page after page.
SECTIONS = {
    "en": ["Overview", "Installation", "Requirements", "Background", "Summary", "Results", "Examples", "Known limitations", "Discussion", "Frequently asked questions", "Next steps", "Usage notes", "Method and data", "Open questions", "Further remarks", "Design goals"],
    "de": ["Überblick", "Voraussetzungen", "Hintergrund", "Ergebnisse", "Beispiele", "Offene Fragen", "Zusammenfassung"],
    "zh": ["概述", "安装步骤", "系统要求", "背景介绍", "结果", "示例", "已知问题", "小结"],
}
SENTENCES = {
    "en": [
        "Most of the {adj} {noun}s that we saw in {year} came from a single {noun}, and nobody had expected that.", "You can {verb}e the {noun} with `{code}`, but it will not help when the {noun} is already {adj}.", "In {name} {v} the {noun} was rewritten; it now handles {n} {noun}s per second.",
        "The older {noun} is still there for people who need it.", "After {n} days of testing, {n}.{d} percent of the {noun}s had failed {adv}.", "As a rule, {adj} {noun}s should be kept away from the {noun} because they {verb}e each other.", "When `{code}` is set to {n}, every {noun} waits until the {noun} has finished.",
        "What does that mean for a {adj} {noun}?", "There are two reasons why {name} does so: the {noun} is {adj}, and its {noun} has to be {verb}ed {adv}.", "On {day} {month} {year} a {adj} {noun} was reported; it turned out that the {noun} had been {verb}ed twice.", "I don't think the {noun} matters much here, since {name} {adv} checks the {noun} anyway.",
        "Note that the {noun} isn't {adj} by default!", "Their paper compares {n} {noun}s with {name} and finds no difference larger than {d}.{d}%.", "Without a {noun}, the {adj} {noun} cannot be {verb}ed and the run has to be started again.",
    ],
    "de": [
        "Die meisten {noun} stammen aus dem Jahr {year}, und damit hatte niemand gerechnet.", "Wer {name} {v} nutzt, sollte `{code}` auf {n} setzen, weil sonst {adj} {noun} entstehen.", "Nach {n} Tagen waren {n},{d} Prozent der {noun} fehlerhaft.", "Warum das so ist, weiß bisher keiner.",
        "Im Vergleich dazu {verb} {name} die {adj} {noun} nur selten.", "Der {noun} {verb} zuerst {adj} {noun} und danach den Rest.",
    ],
    "zh": [
        "大多数{adj}{noun}来自 {year} 年，这是谁也没有想到的。", "把 `{code}` 设为 {n} 以后，{noun}会等待{noun}完成。", "经过 {n} 天的测试，有 {n}.{d}% 的{noun}出现了错误。", "{name} {v} 重写了{noun}，现在每秒可以处理 {n} 条{noun}。", "这样做有两个原因：一是{noun}太大，二是{noun}需要{verb}。", "那么，{adj}{noun}该怎么办呢？", "需要注意的是，{noun}默认并不会{verb}{noun}。",
    ],
}
TITLES = {
    "en": ["How to {verb}e a {adj} {noun}", "An introduction to {adj} {noun}s", "What we learned from {n} {noun}s", "The {adj} {noun}", "{name} {v} is here", "Understanding the {noun}", "Ten facts about {noun}s in {name}", "{name}: an overview", "Why {noun}s fail", "{Code} explained", "{noun} versus {noun}: which is better?", "Guide to {name}", "Running {name} {v} with {adj} {noun}s"],
    "zh": ["怎样{verb}{adj}{noun}", "{noun}入门", "{name} {v} 发布", "理解{noun}", "{adj}{noun}与{noun}的比较", "为什么{noun}会失败", "{name} 使用指南"],
}
TITLES["de"] = [*TITLES["en"], "Einführung in {adj} {noun}", "{name} {v} ist da", "Was {noun} leisten", "{noun} und {noun} im Vergleich"]
WORDS = {
    "noun": {
        "en": "index table cursor parser record window shard query field engine buffer packet schema planner lookup vector kernel replica archive segment".split(),
        "de": "Planer Zerteiler Belege Zitate Absätze Tabellen Felder Speicher Abschnitte Zeitangaben Warteschlange Auswertung Verzeichnis Angaben".split(),
        "zh": "索引 查询 缓存 分词器 记录 网关 字段 窗口 快照 检索器 日志 表格 规划器 版本号 训练样本 网页正文 引用位置".split(),
    },
    "adj": {
        "en": "stale sparse dense nested frozen robust compact lexical partial shared remote bounded hidden random signed".split(),
        "de": "alte lange leere fremde doppelte unklare geprüfte veraltete größere".split(),
        "zh": "增量的 过时的 独立的 临时的 冗余的 多语言的 结构化的 有歧义的 权威的".split(),
    },
    "verb": {
        "en": "merge sort reject delay reload collect verif filter resolv split measur explain truncat".split(),
        "de": "prüft kürzt ordnet sammelt trennt ergänzt verwirft überschreibt".split(),
        "zh": "合并 校验 压缩 丢弃 对齐 统计 归档 限流 回放 重新排序".split(),
    },
}
ADVERBS = "slowly quietly rarely often partially eventually silently".split()
NAMES = [a + " " + b for a in ("Alder", "Brisk", "Corvid", "Dorin", "Elmwood", "Fenwick", "Garnet", "Holm") for b in ("Notebook", "Router", "Store", "Index", "Harbor", "Parser", "Mesh", "Lens")]
MONTH_NAMES = "January February March April May June July August September October November December".split()


class PageWriter:
    """Writes lines with their labels."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def fill(self, text: str, lang: str) -> str:
        r = self.r
        while "{" in text:
            at, end = text.index("{"), text.index("}")
            slot = text[at + 1 : end]
            if slot in WORDS:
                value = r.choice(WORDS[slot][lang])
            elif slot in ("code", "Code"):
                value = r.choice(WORDS["noun"]["en"]) + "_" + r.choice(WORDS["noun"]["en"])
                value = value.capitalize() if slot == "Code" else value
            else:
                value = {"n": str(r.randint(1, 9999)), "d": str(r.randint(0, 9)), "day": str(r.randint(1, 28)), "year": str(r.randint(2019, 2027)), "v": f"{r.randint(0, 9)}.{r.randint(0, 13)}.{r.randint(0, 10)}", "name": r.choice(NAMES), "month": r.choice(MONTH_NAMES), "adv": r.choice(ADVERBS)}[slot]
            text = text[:at] + value + text[end + 1 :]
        return text

    def menu(self, lang: str) -> list[str]:
        r = self.r
        entries = r.sample(MENUS[lang], r.randint(3, min(12, len(MENUS[lang]))))
        if r.random() < 0.4:
            entries.append(r.choice(NAMES))
        style = r.random()
        if style < 0.2:
            return [" | ".join(entries)]
        if style < 0.28:
            return [" · ".join(entries)]
        if style < 0.4:
            return [" ".join(f"[{e}](https://site.example/{i})" for i, e in enumerate(entries))]
        if style < 0.6:
            return [f"[{e}](/{i})" for i, e in enumerate(entries)]
        if style < 0.8:
            return [f"* {e}" for e in entries]
        return entries

    def path(self, lang: str) -> str:
        last = self.r.choice([self.r.choice(MENUS[lang]), self.fill("{noun}", "en").capitalize(), self.fill("{noun}", lang)])
        return self.r.choice([" > ", " » ", " / ", " › "]).join([*self.r.sample(MENUS[lang], self.r.randint(1, 3)), last])

    def title(self, lang: str) -> str:
        return self.fill(self.r.choice(TITLES[lang]), lang)

    def teaser(self, lang: str) -> list[str]:
        r = self.r
        mark = r.choice([["› ", "- ", ""], ["- "], ["› "], ["* "], [""], ["• ", ""]])
        lines = [r.choice(TEASER_HEADS[lang])] if r.random() < 0.95 else []
        return lines + [r.choice(mark) + self.title(r.choice([lang, lang, "en"])) for _ in range(r.randint(1, 6))]

    def notice(self, lang: str) -> str:
        return self.fill(self.r.choice(NOTICES[lang]), lang)

    def sentences(self, lang: str, low: int = 1, high: int = 5) -> str:
        gap = "" if lang == "zh" else " "
        return gap.join(self.fill(self.r.choice(SENTENCES[lang]), lang) for _ in range(self.r.randint(low, high)))

    def body(self, lang: str) -> list[str]:
        r, kind = self.r, self.r.random()
        if kind < 0.5:
            return [self.sentences(lang)]
        if kind < 0.6:
            marks = ["- ", "* ", "1. ", "• "]
            return [r.choice(marks) + (self.fill("{adj} {noun}s", "en") if lang != "zh" or r.random() < 0.2 else self.fill("{adj}{noun}", "zh")) for _ in range(r.randint(1, 5))]
        if kind < 0.66:
            return [r.choice(["- ", "* ", "• "]) + self.sentences(lang, 1, 1) for _ in range(r.randint(1, 4))]
        if kind < 0.76:
            return ["    " + self.fill("{code} = {n}", "en") for _ in range(r.randint(1, 3))]
        if kind < 0.82:
            return ["| " + self.fill("{code} | {v} |", "en") for _ in range(r.randint(1, 3))]
        if kind < 0.92:
            own = "{adj} {noun}" if lang != "zh" else "{adj}{noun}"
            head = self.fill(r.choice(r.choices([DECOYS[lang], SECTIONS[lang], [own]], [4, 4, 3])[0]), lang)
            many = " " in head or lang == "zh" and head not in MENUS["zh"]
            return [(r.choice(["## ", "### ", "# ", ""]) if many else "## ") + head]
        return [self.mixed(lang)]

    def mixed(self, lang: str) -> str:
        """A line that holds page chrome and main body."""
        r, text = self.r, self.sentences(lang, 1, 2)
        short = [n for n in NOTICES[lang] if len(n) < 45]
        chrome = [self.fill(r.choice(short), lang) if r.random() < 0.5 else r.choice(MENUS[lang]) for _ in range(r.randint(1, 3))]
        joined = r.choice([" | ", " · "]).join(chrome)
        return r.choice([f"{joined}{r.choice([' | ', ' – ', ' · ', ' '])}{text}", f"{text}{r.choice([' ', ' ', ' | ', ' – '])}{joined}"])

    def page(self) -> tuple[list[tuple[str, int]], str]:
        """Lines with labels, blank ones between them with the label of the line before, and the page's title."""
        r = self.r
        lang = r.choices(["en", "de", "zh"], [5, 2, 3])[0]
        title = self.title(lang if r.random() < 0.7 else "en")
        out: list[tuple[str, int]] = []

        def put(lines: list[str], label: int) -> None:
            out.extend((line, label) for line in lines)

        def odd() -> None:
            put([self.notice(lang if r.random() < 0.85 else "en")], NOTICE)

        for _ in range(r.randint(0, 2)):
            odd()
        if r.random() < 0.85:
            put(self.menu(lang), MENU)
        if r.random() < 0.3:
            put([self.path(lang)], MENU)
        for _ in range(r.randint(0, 2)):
            odd()
        if r.random() < 0.9:
            put([r.choice(["", "# ", "## "]) + title], BODY)
        for _ in range(r.randint(2, 9)):
            put(self.body(lang), BODY)
            if r.random() < 0.3:
                put([""], BODY)
            if r.random() < 0.12:
                odd()
            if r.random() < 0.05:
                put(self.teaser(lang), TEASER)
        for _ in range(r.randint(0, 2)):
            put(self.teaser(lang), TEASER)
            if r.random() < 0.3:
                put(self.body(lang), BODY)
        for _ in range(r.randint(0, 6)):
            odd()
        if r.random() < 0.1:
            put(self.menu(lang), MENU)
        if r.random() < 0.4 and len(out) > 3:  # an excerpt that begins and ends anywhere
            a, b = sorted(r.sample(range(len(out) + 1), 2))
            out = out[a : max(b, a + 2)]
            if r.random() < 0.7:  # its last line, and sometimes its first, is cut off
                out[-1] = (out[-1][0][: r.randint(len(out[-1][0]) // 3, len(out[-1][0]))], out[-1][1])
            if r.random() < 0.2:
                out[0] = (out[0][0][r.randint(0, len(out[0][0]) // 2) :], out[0][1])
        return out, title


def labelled_pages(count: int, seed: int = 5) -> list[tuple[list[tuple[str, int]], str]]:
    """``count`` pages: lines with their labels, and the title."""
    writer = PageWriter(seed)
    return [writer.page() for _ in range(count)]
