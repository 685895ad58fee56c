"""Elements and texts of raw pages, well formed or not, read by a state machine over Arrow batches.

A page is a run of marks and texts. Marks are found one after another: comments, declarations, start tags with
attributes in double, single or no quotes, end tags; what looks like none is text. A stack holds the open elements: an end
tag closes the last open element of its name and all above it, and is left out where none is open; elements without
content close at once; scripts and styles hold no marks. What is still open ends with the page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that never have content, and those whose content is no markup.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer"}
RAW = {"script", "style"}
ELEMENTS = "array<struct<name:string,at:int,until:int,parent:int,first:int,last:int,attrs:map<string,string>>>"

_ATTRIBUTE = r"""[^\s/>][^\s/=>]*+(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))?+"""
_MARK = re.compile(
    rf"""<!--.*?--\s*>|<!\[CDATA\[.*?\]\]>|<!(?!--)[^>]*+>|<\?[^>]*+>|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>|</\s++(?P<spaced>[a-zA-Z][-.:\w]*+)\s*+>|</[^>]*+>|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|(?<=["'\s/]){_ATTRIBUTE})*+)>""",
    re.S,
)
_PAIR = re.compile(r"""([^\s/>][^\s/=>]*+)(?:\s*+=++\s*+("[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))?+""")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def attributes(source: str) -> dict[str, str]:
    """Names in lower case and values without quotes and entities; of a name that comes twice the last counts."""
    found = {}
    for name, value in _PAIR.findall(source):
        bare = value[1:-1] if value[:1] in ('"', "'") else value
        found[name.lower()] = html.unescape(bare)
    return found


def parsed(page: str, wanted: set[str] | None) -> tuple[list[dict], list[str]]:
    """The wanted elements (None: all) in order of their start tags, each with the places of its marks, the place of the
    element it is in (0: none) and the span of its texts among all texts, which are stripped and not empty."""
    elements: list[dict] = []
    texts: list[str] = []
    open_: list[tuple[str, int, dict | None]] = []
    counts: dict[str, int] = {}
    place, at, held = 0, 0, ""
    end_of_marks = page.rfind(">") + 1

    def text(until: int) -> None:
        nonlocal held
        held += page[at:until]

    def flush() -> None:
        nonlocal held
        told = html.unescape(held).strip()
        if told:
            texts.append(told)
        held = ""

    def close(down_to: int) -> None:
        while len(open_) > down_to:
            name, _, element = open_.pop()
            counts[name] -= 1
            if element is not None:
                element["until"], element["last"] = place, len(texts)

    while (mark := _MARK.search(page, at, end_of_marks)) is not None:
        text(mark.start())
        flush()
        place, at = place + 1, mark.end()
        if (end := mark["end"] or mark["spaced"]) is not None:
            if counts.get(end := end.lower()):
                close(max(i for i, (name, *_) in enumerate(open_) if name == end))
        elif (start := mark["start"]) is not None:
            name = start.lower()
            element = None
            if wanted is None or name in wanted:
                parent = open_[-1][1] if open_ else 0
                element = {"name": name, "at": place, "until": place, "parent": parent, "first": len(texts), "last": len(texts), "attrs": attributes(mark["attrs"])}
                elements.append(element)
            source = mark["attrs"]
            empty = source.endswith("/") and not re.search(r"=\s*[^\s\"'>][^\s>]*/$", source)
            if name not in VOID and not empty:
                open_.append((name, place, element))
                counts[name] = counts.get(name, 0) + 1
                if name in RAW:
                    closes = _RAW_END[name].search(page, at)
                    at = closes.start() if closes else len(page)
    text(len(page))
    flush()
    place += 1
    close(0)
    return elements, texts


def with_elements(pages: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The pages (html, ...) with ``elements`` and ``texts`` in place of html; a null page has none. An element's texts are
    those from ``first`` up to, without, ``last``; one lies inside another if its ``at`` is between that one's at and until."""
    names, kinds = None if wanted is None else set(wanted), pages.drop("html").dtypes

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("at", pa.int32()), ("until", pa.int32()), ("parent", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                both = [parsed(page or "", names) for page in some.column("html").to_pylist()]
                rows = [[e | {"attrs": list(e["attrs"].items())} for e in elements] for elements, _ in both]
                columns = [some.column(n) for n, _ in kinds]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind), pa.array([t for _, t in both], pa.list_(pa.string()))], names=[*(n for n, _ in kinds), "elements", "texts"])

    return pages.mapInArrow(read, ", ".join([*(f"`{n}` {t}" for n, t in kinds), f"elements {ELEMENTS}", "texts array<string>"]))
