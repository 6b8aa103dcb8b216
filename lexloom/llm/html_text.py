"""HTML extraction by composite text density: the densest part of the page's tree, as blocks of text."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

words = lambda s: frozenset(s.split())

VOID = words("area base br col embed hr img input link meta param source track wbr")
BLOCK = words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
)
#: Start tags that end an open paragraph, and end tags that are implied by a later start tag.
ENDS_P = BLOCK - words("body html caption legend tbody td tfoot th thead tr")
SIBLINGS = {"li": words("li"), "dt": words("dt dd"), "dd": words("dt dd"), "tr": words("tr td th"), "td": words("td th"), "th": words("td th"), "option": words("option"), "tbody": words("tbody thead tfoot tr td th")}
FENCES = words("table ul ol dl div article section body td th button")
RAW = words("script style title textarea xmp iframe noembed noframes noscript")
#: Elements that are never text to be read, and those around an article. The latter stay in the tree, as a page's text may be in one, but never in what is chosen.
NOISE = words("head script style title noscript template button select option datalist textarea iframe noembed noframes xmp object applet embed svg canvas audio video map")
SHELL = words("nav footer aside form dialog menu search")
NOISE_ROLES = words("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form")
#: Words in class or id that make an element suspect; those of the second line do not count beside words for content.
NOISE_WORDS = words(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices popup modal overlay"
    " newsletter subscribe subscription comment comments disqus respond replies reactions related recommended share sharing social login signup breadcrumb breadcrumbs pagination pager"
)
SHELL_WORDS = words("sidebar side nav navbar navigation menu menus footer header masthead banner topbar toolbar widget widgets aside rail search alert")
CONTENT_WORDS = words("article content main post entry story body text page wrapper container layout")
HEADINGS = words("h1 h2 h3 h4 h5 h6")

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: One attribute after another: a name, and its value if it has one.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?|["'=]""")
_WORD = re.compile(r"[a-z0-9]+")
#: Classes and ids, as a whole, of reader comments.
COMMENTS = words("comment comments comment-list commentlist comment-section comments-area comment-thread reader-comments respond disqus_thread")
_COMMENT_ID = re.compile(r"comments?[-_]\d+")
#: What a suspect's density counts for: a weak prior, as it can still be the densest part of a page.
SUSPECT = 0.1


def _attributes(source: str) -> dict[str, str]:
    """Names and values in lower case; of a name's repeats the first counts, as in browsers."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        if name:
            found.setdefault(name.lower(), (value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value).lower())
    return found


def _noise(tag: str, attributes: str) -> str:
    """``never`` for an element that isn't text to be read (by its tag, hidden, or reader comments), ``shell`` for one around an article (by its tag or role), ``suspect`` for one
    that words of its class or id make suspect, else nothing.

    A suspect isn't dropped for its words: they weigh on its density, and the density decides. On headings and paragraphs they don't count.
    """
    if tag in NOISE:
        return "never"
    found = _attributes(attributes) if attributes and tag not in ("html", "body") else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "never"
    plain = tag in HEADINGS or tag == "p"
    if not plain and (COMMENTS & {found.get("id", ""), *found.get("class", "").split()} or _COMMENT_ID.fullmatch(found.get("id", ""))):
        return "never"
    if tag in SHELL or found.get("role") in NOISE_ROLES:
        return "shell"
    if not found or plain or tag in ("article", "main"):
        return ""
    names = set(_WORD.findall(f"{found.get('class', '')} {found.get('id', '')}"))
    return "suspect" if names & NOISE_WORDS or names & SHELL_WORDS and not names & CONTENT_WORDS else ""


class Page:
    """The tree without noise: nodes in page order with parents, ends, counts, and the text chunks with their blocks."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end = ["body"], [-1], [0]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.chunks: list[tuple[int, int, str]] = []
        self.suspects: set[int] = set()
        self.shells: set[int] = set()
        self._read(source)

    def _text(self, owner: int, block: int, linked: bool, text: str) -> None:
        text = entities.unescape(text) if "&" in text else text
        if n := len("".join(text.split())):
            self.chars[owner] += n
            if linked:
                self.link_chars[owner] += n
        self.chunks.append((owner, block, text))

    def _read(self, source: str) -> None:
        stack, block, links, articles = [0], 0, 0, 0
        skip: list[str] = []  # open elements from the noisy one down
        at, size, find = 0, len(source), source.find
        while at < size:
            lt = find("<", at)
            if lt < 0:
                lt = size
            if lt > at and not skip:
                self._text(stack[-1], block, links > 0, source[at:lt])
            if lt == size:
                break
            nxt = source[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                if source.startswith("<!--", lt):
                    stop = find("-->", lt + 4)
                    at = size if stop < 0 else stop + 3
                else:
                    stop = find(">", lt)
                    at = size if stop < 0 else stop + 1
                continue
            m = _TAG.match(source, lt)
            if m:
                closing, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
            elif nxt.isalpha() or nxt == "/" and source[lt + 2 : lt + 3].isalpha():
                stop = find(">", lt)
                if stop < 0:
                    break
                m = re.match(r"</?([^\s/>]+)", source[lt:stop])
                closing, tag, attributes, at = "/" if nxt == "/" else "", m[1].lower(), source[lt + len(m[0]) : stop], stop + 1
            else:
                if not skip:
                    self._text(stack[-1], block, links > 0, "<")
                at = lt + 1
                continue
            if tag in ("html", "body"):
                continue
            if closing:
                if skip:
                    if tag in skip:
                        del skip[len(skip) - 1 - skip[::-1].index(tag) :]
                        block += not skip
                        continue
                    if tag not in BLOCK or tag not in (self.tag[i] for i in stack[1:]):
                        continue
                    skip.clear()  # an element around the noisy one ends
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t == tag:
                        links, articles = self._close(stack, k, links, articles)
                        break
                    if t in FENCES and tag not in BLOCK:
                        break
                if tag in BLOCK:
                    block += 1
                continue
            selfclosed = attributes.endswith("/")
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if skip:
                if tag not in VOID and not selfclosed:
                    skip.append(tag)
                continue
            noise = "shell" if tag == "header" and not articles else _noise(tag, attributes)
            if noise == "never":
                block += 1
                if tag not in VOID and not selfclosed:
                    if tag in ENDS_P:
                        links, articles = self._end_p(stack, links, articles)
                    skip = [tag]
                continue
            if tag in ENDS_P:
                links, articles = self._end_p(stack, links, articles)
            if tag in SIBLINGS:
                k = len(stack) - 1
                while k > 0 and self.tag[stack[k]] not in SIBLINGS[tag] and self.tag[stack[k]] not in FENCES:
                    k -= 1
                while k > 0 and self.tag[stack[k]] in SIBLINGS[tag]:
                    links, articles = self._close(stack, k, links, articles)
                    k -= 1
            if tag in BLOCK:
                block += 1
            node = len(self.tag)
            if noise:
                (self.shells if noise == "shell" else self.suspects).add(node)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.end.append(node)
            for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
                counts.append(0)
            if tag == "br":
                self.chunks.append((stack[-1], block, " "))
            if tag not in VOID and not selfclosed:
                stack.append(node)
                links += tag == "a"
                articles += tag in ("article", "main")
        self._close(stack, 1, 0, 0)
        for node in range(len(self.tag) - 1, 0, -1):
            up = self.parent[node]
            self.end[up] = max(self.end[up], self.end[node])
            self.chars[up] += self.chars[node]
            self.tags[up] += self.tags[node] + 1
            self.link_chars[up] += self.link_chars[node]
            self.link_tags[up] += self.link_tags[node] + (self.tag[node] == "a")

    def _close(self, stack: list[int], k: int, links: int, articles: int) -> tuple[int, int]:
        for node in stack[k:]:
            links -= self.tag[node] == "a"
            articles -= self.tag[node] in ("article", "main")
        del stack[k:]
        return links, articles

    def _end_p(self, stack: list[int], links: int, articles: int) -> tuple[int, int]:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t == "p":
                return self._close(stack, k, links, articles)
            if t in BLOCK:
                break
        return links, articles

    def density(self, node: int, body_links: float) -> float:
        """Characters per tag, adjusted by the share of links."""
        c, t = self.chars[node], max(1, self.tags[node])
        if not c:
            return 0.0
        lc, lt = max(1, self.link_chars[node]), max(1, self.link_tags[node])
        plain = max(1, c - self.link_chars[node])
        base = math.log(c / plain * lc + body_links * c + math.e)
        return c / t * math.log(c / lc * t / lt) / math.log(base)

    def densities(self) -> tuple[list[float], list[float]]:
        """The density of each block, and the sum of those of its child blocks (and of the text beside them); those of suspects and all in them count for less."""
        n = len(self.tag)
        ratio = self.link_chars[0] / max(1, self.chars[0])
        density, total, own = [0.0] * n, [0.0] * n, list(self.chars)
        prior = [1.0] * n
        for i in range(n):
            if i:
                prior[i] = 1.0 if self.tag[i] in ("article", "main") else SUSPECT if i in self.suspects or i in self.shells else prior[self.parent[i]]
            if self.tag[i] not in BLOCK:
                continue
            density[i] = self.density(i, ratio) * prior[i]
            if i and (up := self._block_above(i)) >= 0:
                total[up] += density[i]
                own[up] -= self.chars[i]
        for i in range(n):  # text that stands beside child blocks counts as one more child
            if total[i] and own[i] > 0:
                total[i] += own[i] * prior[i]
        return density, total

    def _trusted(self) -> int:
        """Characters outside of shells and suspects."""
        left, end = self.chars[0], 0
        for i in sorted(self.shells | self.suspects):
            if i > end:
                left, end = left - self.chars[i], self.end[i]
        return left

    def _block_above(self, node: int) -> int:
        up = self.parent[node]
        while up > 0 and self.tag[up] not in BLOCK:
            up = self.parent[up]
        return up

    def content(self) -> list[int]:
        """The nodes whose subtrees are the main text: that of the greatest density sum (the first of equals), and what belongs to it by the body path's threshold.

        The threshold is the least density on the path from that node up to the body. Blocks beside the path belong to the text if they are as dense; within the
        elements that lie between it is enough not to be links for the most part, unless their class or id makes them suspect.
        """
        if not self.chars[0]:
            return []
        n = len(self.tag)
        density, total = self.densities()
        blocks = [i for i in range(n) if self.tag[i] in BLOCK]
        best = max(blocks, key=lambda i: total[i])
        if best == 0 or not total[best]:  # of a page of a few words the sums say little
            named = max((i for i in blocks if self.tag[i] in ("article", "main")), key=lambda i: self.chars[i], default=0)
            return [named if self.chars[named] * 2 > self._trusted() else 0]
        path = [best]
        while path[-1] > 0:
            path.append(self._block_above(path[-1]))
        threshold = min(density[i] for i in path)
        chosen = [best]
        for i in blocks:
            if not self.chars[i] or i in path or i in self.shells and self._block_above(i) or (up := self._block_above(i)) not in path[1:]:
                continue
            plain = self.link_chars[i] * 2 <= self.chars[i]
            if up:
                belongs = plain if i not in self.suspects else density[i] >= threshold
            else:
                belongs = plain and self.tag[i] in ("h1", "h2") or density[i] >= threshold and total[i] > 0
            if belongs:
                chosen.append(i)
        return sorted(chosen)

    def dropped(self, chosen: list[int]) -> list[bool]:
        """For each node whether it is in a shell within what is chosen, or in a suspect that is less dense than all blocks around it; within an article or main, only if it is mostly links."""
        ratio = self.link_chars[0] / max(1, self.chars[0])
        gone, least, inside = [False], [self.density(0, ratio)], [False]
        for i in range(1, len(self.tag)):
            up = self.parent[i]
            block, suspect = self.tag[i] in BLOCK, i in self.suspects
            own = self.density(i, ratio) if block or suspect else math.inf
            if i in chosen:
                gone.append(False)
            elif suspect:
                gone.append(gone[up] or (own < least[up] and self.link_chars[i] * 2 > self.chars[i] if inside[up] else own * SUSPECT < least[up]))
            else:
                gone.append(gone[up] or i in self.shells)
            least.append(min(least[up], own) if block and not suspect else least[up])
            inside.append(inside[up] or self.tag[i] in ("article", "main"))
        return gone

    def text(self) -> str:
        chosen = self.content()
        gone = self.dropped(chosen) if self.suspects or self.shells else None
        out: list[str] = []
        last, parts = None, []
        k = 0
        for owner, block, text in self.chunks:
            while k < len(chosen) and self.end[chosen[k]] < owner and (k + 1 < len(chosen) and owner >= chosen[k + 1]):
                k += 1
            if k >= len(chosen) or not chosen[k] <= owner <= self.end[chosen[k]] or gone and gone[owner]:
                continue
            if block != last:
                out.append(" ".join("".join(parts).split()))
                last, parts = block, []
            parts.append(text)
        out.append(" ".join("".join(parts).split()))
        return "\n\n".join(x for x in out if x)


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, then ``text`` (the blocks of the main text, joined by an empty line; empty if there is none) and ``n_chars``.

    Null and empty pages have an empty text. Broken markup is read as browsers do: missing end tags are implied, stray ones
    ignored. The whole page is read at any length, without recursion. Repeated rows are each extracted; an empty table gives an empty
    result; columns outside ``keep`` are not read, so their names can't clash.
    """
    taken = pages.select(*(F.col(c).alias(f"_keep_{c}") for c in keep), F.col(html_col).alias("_html"))
    rest = taken.schema.fields[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column("_html").to_pylist()]
                names = [f.name for f in rest]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names + ["text", "n_chars"])

    found = taken.mapInArrow(run, schema)
    return found.select(*(F.col(f"_keep_{c}").alias(c) for c in keep), "text", "n_chars")
