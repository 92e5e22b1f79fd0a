"""Pages: HTML to Markdown without chrome, titles and links, and line-level cleaning of page text."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

#: Elements whose content is never shown as text of the page.
SKIPPED = frozenset("head script style noscript svg template nav footer form canvas".split())
#: Words in role, id or class that mark a container of page chrome.
CHROME_WORDS = frozenset("nav navbar navigation menu sidebar footer breadcrumb breadcrumbs cookie cookies banner advert ads toolbar pagination".split())
CHROME_ROLES = frozenset("navigation banner contentinfo search complementary menu menubar".split())
#: Lines that are page chrome, alone or as beginnings.
CHROME_LINES = frozenset("home menu search login signup copyright breadcrumb navigation 登录 注册 首页 导航 菜单 搜索".split())
CHROME_STARTS = (
    "skip to ", "skip navigation", "log in ", "sign up ", "reload to refresh", "you signed out", "table of contents",
    "main menu", "copyright ", "cookie policy", "privacy policy", "terms of use", "breadcrumb ",
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section article main header ul ol table tr blockquote dl dt dd figure figcaption address details summary body html".split())


def markdown_table(rows: list[list[str]]) -> str:
    """Rows as a Markdown table, padded to the widest, the first one as its head; '' for none."""
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join([*(c.replace("|", "\\|") for c in r), *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class _Page(HTMLParser):
    """One pass over a page: Markdown blocks, title, metadata and links."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.blocks, self.line = base, [], []
        self.title, self.meta, self.links = "", {}, []
        self.open: list[tuple[str, bool]] = []
        self.lists: list[list] = []
        self.rows: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.code = 0
        self.target, self.label = None, []

    def flush(self, prefix: str = "") -> None:
        text = re.sub(r"\s+", " ", "".join(self.line)).strip()
        self.line = []
        if text:
            self.blocks.append(prefix + text)

    def hidden(self) -> bool:
        return any(h for _, h in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"])
        if tag in VOID:
            if tag == "br" and not self.hidden():
                self.line.append("\n" if self.code else " ")
            return
        words = set(re.split(r"[\s_-]+", f"{a.get('id', '')} {a.get('class', '')}".lower()))
        chrome = tag in SKIPPED or a.get("role", "").lower() in CHROME_ROLES or tag not in ("body", "html", "main", "article") and bool(words & CHROME_WORDS) or "hidden" in a
        self.open.append((tag, chrome))
        if tag == "a":
            self.target, self.label = a.get("href"), []
        if self.hidden():
            return
        if tag == "pre":
            self.flush()
            self.code += 1
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "table":
            self.flush()
            self.rows.append([])
        elif tag == "tr" and self.rows:
            self.rows[-1].append([])
        elif tag in ("td", "th") and self.rows and self.rows[-1]:
            self.cell = []
        elif tag in BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            if self.cell is None:
                self.flush()

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        shown = not self.hidden()
        if tag == "a" and self.target is not None:
            text, url = re.sub(r"\s+", " ", "".join(self.label)).strip(), urljoin(self.base, self.target.strip())
            if url.startswith(("http://", "https://")):
                self.links.append((url.split("#")[0], text[:180]))
                if shown and text and not self.code:
                    mark = f"[{text}]({url})"
                    (self.cell if self.cell is not None else self.line).append(mark)
            elif shown and text:
                (self.cell if self.cell is not None else self.line).append(text)
            self.target = None
        if shown:
            if re.fullmatch("h[1-6]", tag):
                self.flush("#" * int(tag[1]) + " ")
            elif tag == "li" and self.lists:
                self.lists[-1][1] += 1
                kind, n = self.lists[-1]
                self.flush("  " * (len(self.lists) - 1) + (f"{n}. " if kind == "ol" else "- "))
            elif tag in ("ul", "ol") and self.lists:
                self.flush()
                self.lists.pop()
            elif tag in ("td", "th") and self.cell is not None:
                self.rows[-1][-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
                self.cell = None
            elif tag == "table" and self.rows:
                rows = [r for r in self.rows.pop() if r]
                toc = len(rows) == 1 and all(re.fullmatch(r"\[[^\]]*\]\(#[^)]*\)|", c) for c in rows[0])
                if rows and not toc:
                    self.blocks.append(markdown_table(rows))
            elif tag == "pre" and self.code:
                self.code -= 1
                text = "".join(self.line).strip("\n")
                self.line = []
                if text.strip():
                    self.blocks.append(f"```\n{text}\n```")
            elif tag in BLOCKS and self.cell is None:
                self.flush()
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data: str) -> None:
        if any(t == "title" for t, _ in self.open):
            self.title += data
        if self.target is not None:
            self.label.append(data)
        elif not self.hidden():
            (self.cell if self.cell is not None else self.line).append(data)


def read_page(html: str | None, base: str = "") -> dict:
    """title, markdown, description, published, modified, links [(url, text)] (each URL once) and quality of a page; '' and none for null."""
    page = _Page(base)
    page.feed(html or "")
    page.close()
    page.flush()
    body = "\n\n".join(page.blocks)
    first = lambda *names: next((page.meta[n] for n in names if page.meta.get(n)), "")
    return {
        "title": re.sub(r"\s+", " ", page.title).strip(),
        "markdown": body,
        "description": first("description", "og:description"),
        "published": first("article:published_time", "datepublished", "date", "dc.date"),
        "modified": first("article:modified_time", "datemodified", "last-modified", "og:updated_time"),
        "links": list(dict.fromkeys(page.links)),
        "quality": round(min(1.0, len(body) / 1800), 4),
    }


_picture = re.compile(r"!\[[^\]]*\]\([^)]*\)|\[image[^\]]*\]", re.IGNORECASE)
_link = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")


def clean_lines(text: str | None) -> dict:
    """Text without navigation lines, pictures and repeated lines; code fences are kept as they are. With counts of what was removed."""
    raw = (text or "").replace("\x00", "").replace("\r\n", "\n")
    out: list[str] = []
    seen: set[str] = set()
    navigation = pictures = chars = 0
    fenced = False
    for line in raw.splitlines():
        if line.strip().startswith("```"):
            fenced = not fenced
            out.append(line.strip())
            continue
        if fenced:
            out.append(line.rstrip())
            continue
        full = re.sub(r"\s+", " ", line).strip()
        if not full:
            continue
        kept = _picture.sub("", full).strip()
        if not kept:
            pictures += 1
            continue
        kept = _link.sub(lambda m: m.group() if re.match("https?://", m.group(2), re.IGNORECASE) else m.group(1), kept)
        kept = re.sub(r"<[^<>]*>", " ", kept)
        plain = re.sub(r"\s+", " ", re.sub(r"[`*_#|<>]", " ", re.sub(r"https?://\S+", "", _link.sub(r"\1", kept)))).strip(" -:;,.[]()").casefold()
        if len(plain) <= 180 and (not plain or plain in CHROME_LINES or plain.startswith(CHROME_STARTS)):
            navigation += 1
            chars += len(full)
            continue
        kept = re.sub(r"\s+", " ", kept).strip()
        if kept.casefold() in seen:
            continue
        seen.add(kept.casefold())
        out.append(kept)
    body = "\n".join(out).strip()
    return {"text": body, "raw_chars": len(raw), "clean_chars": len(body), "content_lines": len(out), "navigation_lines": navigation, "picture_lines": pictures, "navigation_ratio": round(chars / max(1, len(raw)), 4)}


_loc = re.compile(r"<loc>\s*(.*?)\s*</loc>", re.IGNORECASE | re.DOTALL)


def sitemap_urls(xml: str | None, children: int = 2) -> tuple[list[str], list[str]]:
    """Page URLs of a sitemap and the first ``children`` sitemaps it names, English ones first; each URL once, in order."""
    found = list(dict.fromkeys(u.replace("&amp;", "&") for u in _loc.findall(xml or "") if u))
    nested = [u for u in found if re.search(r"\.xml(\.gz)?($|\?)", u)]
    nested.sort(key=lambda u: not re.search(r"(^|[/_.-])en([/_.-]|$)", u))
    return [u for u in found if u not in nested], nested[:children]
