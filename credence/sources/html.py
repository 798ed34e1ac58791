"""One-pass page reader: tags are cut out with one regular
expression and a single loop keeps the open elements' depths, so the cost is
linear in the page, whatever is left unclosed or nested."""

from __future__ import annotations

import html as _html
import re
from urllib.parse import urljoin, urlsplit

# a tag ends at its '>' or is none: stopping at the next '<' keeps the search linear
TOKEN = re.compile(r"<!--|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>|<[!?][^<>]*>")
ATTR = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = ("script", "style")
REMOVED = ("nav", "footer", "header")
#: elements whose start or end tag ends the text unit before it
BLOCKS = frozenset("""address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure
form h1 h2 h3 h4 h5 h6 hr html li main ol p pre section table tbody td tfoot th thead tr ul""".split())
#: elements that may show a film, and hosts whose embedded pages are films
FILM_TAGS = ("iframe", "embed", "object", "video", "source")
FILM_HOSTS = ("youtube", "youtu.be", "vimeo", "dailymotion", "kewego", "twitch")
#: where a page names its main picture, best first
TOP_IMAGE_META = (("property", "og:image"), ("name", "og:image"), ("name", "twitter:image"), ("property", "twitter:image"))
DATE_KEYS = (("property", "article:published_time"), ("name", "publish_date"), ("name", "date"))


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


def resolve(base: str, ref: str | None) -> str:
    """A reference as an absolute URL (dot segments, ``//host/path``, query
    only, ...); as it stands where it cannot be resolved."""
    ref = (ref or "").strip()
    try:
        return urljoin(base, ref) if ref else ""
    except ValueError:
        return ref


def is_film(tag: str, url: str) -> bool:
    if tag in ("video", "source"):
        return True
    try:
        host = urlsplit(url).hostname or ""
    except ValueError:
        return False
    return any(h in host for h in FILM_HOSTS)


def read_page(page: str | None, url: str | None = "") -> dict:
    """One page's title, primary (units of the article, or paragraphs without
    one, by blank lines), fallback (all article text, or all paragraphs, by
    spaces), authors, publish_date, meta_description, meta_keywords, images as
    written (raw_images), and images, top_image and videos as absolute URLs:
    resolved against ``url``, or the page's base element where it has one."""
    page = page or ""
    lower = page.lower()
    if len(lower) != len(page):  # a letter whose lower case is longer: only ASCII tags matter
        lower = "".join(c.lower() if c.isascii() else c for c in page)
    pos, depth = 0, dict.fromkeys(REMOVED, 0)
    article = None  # depth inside the first article; None before it, 0 after it
    h1, in_p, in_h1 = None, False, 0
    title, meta, images = None, {}, []
    films: list[tuple[str, str]] = []
    base, in_video, named_image = None, 0, None
    units: list[list[str]] = [[]]  # of the article, without its main heading
    paras: list[list[str]] = []
    nodes: list[str] = []  # all of the article
    para_nodes: list[list[str]] = []

    def text(raw: str) -> None:
        t = _html.unescape(raw).strip() if raw else ""
        if in_h1 and h1 is not None and not h1_done:
            h1.append(_html.unescape(raw))
        if in_p:
            para_nodes[-1].append(t)
            if t:
                paras[-1].append(t)
        if article and t:
            nodes.append(t)
            if not in_h1:
                units[-1].append(t)

    h1_done = False
    while True:
        m = TOKEN.search(page, pos)
        if not any(depth.values()):
            text(page[pos:m.start() if m else len(page)])
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                end = page.find("-->", pos)
                pos = len(page) if end < 0 else end + 3
            continue
        name, close = m[2].lower(), bool(m[1])
        if name in RAW and not close:
            end = lower.find(f"</{name}", pos)
            gt = page.find(">", end) if end >= 0 else -1
            pos = len(page) if gt < 0 else gt + 1
            continue
        if name in depth:
            if close:
                depth[name] = max(0, depth[name] - 1)
            elif not m[3].endswith("/"):
                depth[name] += 1
        if any(depth.values()):
            continue
        if name == "title" and not close and title is None:
            end = lower.find("</title", pos)
            raw = page[pos:end] if end >= 0 else ""
            title = "" if re.search(r"<[A-Za-z/!]", raw) else _html.unescape(raw).strip()
            gt = page.find(">", end) if end >= 0 else -1
            pos = gt + 1 if gt >= 0 else pos
            continue
        if name == "meta" and not close:
            a = attributes(m[3])
            for key in ("property", "name"):
                if key in a:
                    meta.setdefault((key, a[key].lower()), a.get("content", ""))
        elif name == "img" and not close:
            src = attributes(m[3]).get("src")
            if src is not None:
                images.append(_html.unescape(src))
        elif name == "base" and not close and base is None:
            base = attributes(m[3]).get("href")
        elif name == "link" and not close:
            a = attributes(m[3])
            if named_image is None and a.get("rel", "").lower() in ("image_src", "img_src"):
                named_image = a.get("href")
        elif name in FILM_TAGS:
            if name == "video":
                in_video = 0 if close else 1
            a = {} if close or name == "source" and not in_video else attributes(m[3])
            src = a.get("data" if name == "object" else "src")
            if src:
                films.append((name, src))
        if name in BLOCKS:
            units.append([])
            in_p = False
            if name == "p" and not close:
                in_p = True
                paras.append([])
                para_nodes.append([])
        if name == "h1":
            if close:
                in_h1, h1_done = 0, h1_done or h1 is not None
            else:
                in_h1 = 1
                h1 = [] if h1 is None else h1
        elif name == "article":
            if not close and (article is None or article > 0):
                article = (article or 0) + 1
            elif close and article:
                article -= 1
    had_article = article is not None
    primary = [" ".join(u) for u in (units if had_article else paras) if u]
    fallback = " ".join(nodes) if had_article else " ".join("".join(p) for p in para_nodes)
    date = next((meta[k] for k in DATE_KEYS if k in meta), None)
    author = meta.get(("name", "author"))
    base = resolve(url or "", _html.unescape(base)) if base else url or ""
    top = next((meta[k] for k in TOP_IMAGE_META if meta.get(k)), named_image)
    top = _html.unescape(top) if top else next((i for i in images if i.strip()), "")
    videos = [(tag, resolve(base, _html.unescape(src))) for tag, src in films]
    return {
        "title": title if title is not None else "".join(h1 or []).strip(),
        "primary": "\n\n".join(primary), "fallback": fallback.strip(),
        "authors": [] if author is None else [_html.unescape(author)],
        "publish_date": None if date is None else _html.unescape(date),
        "meta_description": _html.unescape(meta.get(("name", "description"), "")),
        "meta_keywords": [k.strip() for k in _html.unescape(meta.get(("name", "keywords"), "")).split(",") if k.strip()],
        "images": [resolve(base, i) for i in images], "raw_images": images,
        "top_image": resolve(base, top),
        "videos": list(dict.fromkeys(v for tag, v in videos if is_film(tag, v))),
    }


#: a byte order mark, then a charset in the first bytes, decide how a page is read
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
CHARSET = re.compile(rb"""<meta[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
SNIFFED = 1024


def decode_page(raw: bytes | None) -> str:
    """The text of a page's bytes: by its byte order mark, else the charset
    of a meta tag, else UTF-8, else windows-1252.  Bytes that are none of it
    become U+FFFD."""
    raw = raw or b""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return raw[len(mark):].decode(name, "replace")
    m = CHARSET.search(raw[:SNIFFED])
    name = m[1].decode().lower() if m else "utf-8"
    if name in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii"):
        name = "windows-1252"  # as browsers read them
    elif name.startswith("utf-16"):
        name = "utf-8"  # a tag that ASCII bytes spell is not in UTF-16
    try:
        return raw.decode(name)
    except (UnicodeDecodeError, LookupError):
        pass
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("windows-1252", "replace")
