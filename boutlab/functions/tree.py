"""Pages as trees: one scan gives every element its span, and nesting becomes a test of spans.

A page's elements stand in one array in page order, so those inside an element are the slice that follows
it, and its text is a slice of the page's texts. The scan itself goes through the tags once; a running
depth over an array is what column expressions cannot do without copying the array at every step.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutlab.session import ship_package

NODE = T.StructType(
    [
        T.StructField("at", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        # The last element inside, the enclosing element, and how many of the same kind enclose this one.
        T.StructField("last", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("text_from", T.IntegerType()),
        T.StructField("text_to", T.IntegerType()),
    ]
)
TREE = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("texts", T.ArrayType(T.StringType()))])
PAGE = "#page"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>=]|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?P<closed>>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Fixed values of the markup language: elements without content; elements that end others of their kind
# when they start, and the elements that shield those.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CELLS, _ROWS = {"td", "th"}, {"tr", "td", "th"}
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "p": ({"p"}, {"div", "li", "td", "th", "table", "ul", "ol", "section", "article", "body"}),
    "td": (_CELLS, {"table", "tr"}),
    "th": (_CELLS, {"table", "tr"}),
    "tr": (_ROWS, {"table"}),
    "tbody": (_ROWS | {"tbody", "thead", "tfoot"}, {"table"}),
}
# A closing tag inside a cell ends nothing outside it, but for parts of tables and the page.
_SHIELD = {"td", "th", "table"}
_THROUGH = _ROWS | {"table", "tbody", "thead", "tfoot", "body", "html"}


OPEN, CLOSE, TEXT = range(3)


def walk(page: str, kinds: frozenset[str] | None = None) -> Iterator[tuple]:
    """(OPEN, tag, level, rest of the tag), (CLOSE, ...) and (TEXT, text) in page order, elements of ``kinds`` only.

    An element that is never closed ends where an element around it does; a closing tag without an opening
    one is passed over; comments, scripts and styles are no part of the page. Every tag is looked at once,
    but for the open elements a closing tag goes back over.
    """
    stack, levels = [PAGE], Counter()
    for token in _TOKEN.finditer(page):
        _, ending, tag, rest, closed, text = token.groups()
        if text:
            if "&" in text:
                text = entities.unescape(text)
            yield TEXT, text.replace("\xa0", " "), 0, None
            continue
        # A tag that the page ends in is none.
        if not tag or not closed:
            continue
        tag, cut = tag.lower(), len(stack)
        if ending:
            for i in range(len(stack) - 1, 0, -1) if levels[tag] else ():
                if stack[i] == tag:
                    cut = i
                    break
                if stack[i] in _SHIELD and tag not in _THROUGH:
                    break
        else:
            ended, shield = ENDED_BY.get(tag, ((), ()))
            left, i = sum([levels[t] for t in ended]), cut
            while left and (i := i - 1) and (stack[i] in ended or stack[i] not in shield):
                if stack[i] in ended:
                    cut, left = i, left - 1
        while len(stack) > cut:
            levels[stack[-1]] -= 1
            if kinds is None or stack[-1] in kinds:
                yield CLOSE, stack[-1], 0, None
            stack.pop()
        if ending:
            continue
        listed = kinds is None or tag in kinds
        if listed:
            yield OPEN, tag, levels[tag], rest
        if tag not in VOID and not rest.endswith("/"):
            stack.append(tag)
            levels[tag] += 1
        elif listed:
            yield CLOSE, tag, 0, None
    for tag in stack[:0:-1]:
        if kinds is None or tag in kinds:
            yield CLOSE, tag, 0, None


@functools.lru_cache(10_000)
def _attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag, for reading only: pages repeat their tags."""
    attrs = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        attrs.setdefault(name.lower(), entities.unescape(next(filter(None, values), "")))
    return attrs


class _Listing:
    """Elements in page order and texts, of a page or of a part of one; the first element is all of it."""

    def __init__(self):
        self.nodes, self.texts, self.open = [[0, PAGE, [], {}, 0, -1, 0, 0, 0]], [], [0]

    def start(self, tag: str, level: int, attrs: dict[str, str]) -> None:
        at, before = len(self.nodes), len(self.texts)
        self.nodes.append([at, tag, attrs.get("class", "").split(), attrs, at, self.open[-1], level, before, before])
        self.open.append(at)

    def end(self) -> None:
        node = self.nodes[self.open.pop()]
        node[4], node[8] = len(self.nodes) - 1, len(self.texts)

    def done(self) -> tuple[list[list], list[str]]:
        while self.open:
            self.end()
        return self.nodes, self.texts


def scan(page: str, kinds: frozenset[str] | None = None) -> tuple[list[list], list[str]]:
    """Elements in page order and texts of a page, see ``walk``; the first element is the page itself."""
    listing = _Listing()
    for event, value, level, rest in walk(page, kinds):
        if event == TEXT:
            listing.texts.append(value)
        elif event == OPEN:
            listing.start(value, level, _attributes(rest))
        else:
            listing.end()
    return listing.done()


@dataclass(frozen=True)
class Kind:
    """Elements of a tag that have every one of the classes, or with ``starts`` one that begins so."""

    tag: str
    classes: tuple[str, ...] = ()
    starts: bool = False

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag != self.tag:
            return False
        own = attrs.get("class", "").split()
        if self.starts:
            return all(any(o.startswith(c) for o in own) for c in self.classes)
        return all(c in own for c in self.classes)


def scan_parts(
    page: str, kinds: frozenset[str], unit: Kind, within: Kind | None = None, width: int = 1
) -> Iterator[tuple]:
    """(position, position of the element around, level, elements, texts) per element of a kind, as each ends.

    Only open elements of the kind are held, so a page of any length takes the memory of its largest one.
    ``within`` asks for those inside the first element of another kind. ``width`` puts so many successive
    ones into a part, whose position is theirs divided by the width; a short last part is none. The element
    around is the next one of the same tag, -1 if that is not of the kind, None if there is none.
    """
    listed = kinds | {unit.tag} | ({within.tag} if within else set())
    begun, count = within is None, 0
    # Open elements: the listing of one of the kind, True for the one all must be in, None for others.
    stack: list = []
    active: list[_Listing] = []
    around: list[int] = []
    waiting: dict[int, dict[int, _Listing]] = {}
    places: dict[int, tuple] = {}
    for event, value, level, rest in walk(page, listed):
        if event == TEXT:
            for listing in active:
                listing.texts.append(value)
        elif event == OPEN:
            own = None
            attrs = _attributes(rest) if active or value == unit.tag or within and value == within.tag else {}
            if begun and unit.fits(value, attrs):
                own = _Listing()
                places[id(own)] = (count, around[-1] if around else None, level)
                active.append(own)
                count += 1
            # What the parts around do not ask for is listed in its own only.
            holders = len(active) if value in kinds else 0
            for listing in active[:holders] if holders or own is None else [own]:
                listing.start(value, level, attrs)
            if value == unit.tag:
                around.append(count - 1 if own is not None else -1)
            if not begun and within.fits(value, attrs):
                begun, own = True, True
            stack.append((own, holders))
        else:
            own, holders = stack.pop()
            for listing in active[:holders]:
                listing.end()
            if value == unit.tag:
                around.pop()
            if own is True:
                return
            if own is None:
                continue
            active.pop()
            pos, outer, level = places.pop(id(own))
            if width == 1:
                yield pos, outer, level, *own.done()
                continue
            group = waiting.setdefault(pos // width, {})
            group[pos] = own
            if len(group) == width:
                del waiting[pos // width]
                yield pos // width, outer, level, *_together([group[p].done() for p in sorted(group)])


def _together(parts: list[tuple]) -> tuple[list[list], list[str]]:
    """Several parts as one, their outermost elements side by side."""
    whole = _Listing()
    for nodes, texts in parts:
        at, before = len(whole.nodes) - 1, len(whole.texts)
        for n in nodes[1:]:
            moved = [n[4] + at, n[5] + at if n[5] else 0, n[6], n[7] + before, n[8] + before]
            whole.nodes.append([n[0] + at, *n[1:4], *moved])
        whole.texts += texts
    return whole.done()


_STRINGS = pa.list_(pa.string())
_ARROW_NODE = [
    ("at", pa.int32()), ("tag", pa.string()), ("classes", _STRINGS), ("attrs", pa.map_(pa.string(), pa.string())),
    ("last", pa.int32()), ("parent", pa.int32()), ("level", pa.int32()), ("text_from", pa.int32()), ("text_to", pa.int32()),
]


def _arrow_trees(found: list[tuple | None]) -> pa.Array:
    """Trees as Arrow columns; None is a missing one."""
    starts, rows = [0], []
    for tree in found:
        rows += tree[0] if tree else []
        starts.append(len(rows))
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW_NODE)
    # Elements share the attributes of equal tags, which are made into columns once.
    distinct: dict[int, int] = {}
    places = pa.array([distinct.setdefault(id(a), len(distinct)) for a in columns[3]], pa.int64())
    shared = list({id(a): a for a in columns[3]}.values())
    columns[2] = [a.get("class", "").split() for a in shared]
    columns[3] = [list(a.items()) for a in shared]
    arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _ARROW_NODE, strict=True)]
    arrays[2:4] = [arrays[2].take(places), arrays[3].take(places)]
    nodes = pa.ListArray.from_arrays(
        pa.array(starts, pa.int32()), pa.StructArray.from_arrays(arrays, names=[n for n, _ in _ARROW_NODE])
    )
    texts = pa.array([tree[1] if tree else [] for tree in found], _STRINGS)
    missing = pa.array([tree is None for tree in found], pa.bool_())
    return pa.StructArray.from_arrays([nodes, texts], names=["nodes", "texts"], mask=missing)


#: Elements and texts in a batch of trees that leaves a task.
BATCH_ITEMS = 50_000


def _mapped(
    pages: DataFrame, kept: Sequence[str], fields: list[T.StructField], found_in: Callable[[str], Iterable[tuple]]
) -> DataFrame:
    """Columns ``kept``, numbers ``fields`` and ``tree`` of what is found in each page, in batches of bounded size."""
    ship_package(pages.sparkSession)
    schema = T.StructType([*[pages.schema[c] for c in kept], *fields, T.StructField("tree", TREE)])
    names, width = schema.names, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, trees, items = [], [], [], 0

            def flushed() -> pa.RecordBatch:
                own = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(width)]
                counted = [pa.array(c, pa.int32()) for c in zip(*numbers, strict=True)] if fields else []
                return pa.RecordBatch.from_arrays([*own, *counted, _arrow_trees(trees)], names=names)

            for row in range(batch.num_rows):
                for *number, tree in found_in(batch.column(width)[row].as_py() or ""):
                    rows.append(row)
                    numbers.append(number)
                    trees.append(tree)
                    items += len(tree[0]) + len(tree[1]) if tree else 1
                    if items >= BATCH_ITEMS:
                        yield flushed()
                        rows, numbers, trees, items = [], [], [], 0
            if rows:
                yield flushed()

    return pages.select(*kept, F.col("html").cast("string").alias("html")).mapInArrow(run, schema)


def with_tree(pages: DataFrame, kinds: Sequence[str] | None = None, kept: Sequence[str] = ("page_id",)) -> DataFrame:
    """Columns ``kept`` and ``tree``, the scanned ``html``; a null page is one without elements."""
    listed = frozenset(kinds) if kinds is not None else None
    return _mapped(pages, kept, [], lambda html: [(scan(html, listed),)])


PART_FIELDS = [T.StructField(name, T.IntegerType()) for name in ("pos", "around", "level")]


def with_parts(
    pages: DataFrame,
    kinds: Sequence[str],
    unit: Kind,
    kept: Sequence[str] = ("page_id",),
    within: Kind | None = None,
    width: int = 1,
) -> DataFrame:
    """A row per element of a kind, or per ``width`` of them: ``kept``, ``pos``, ``around``, ``level``, its ``tree``.

    For pages with long lists: no page's tree is ever whole, see ``scan_parts``.
    """
    listed = frozenset(kinds)

    def found_in(html: str) -> Iterator[tuple]:
        for pos, around, level, nodes, texts in scan_parts(html, listed, unit, within, width):
            yield pos, around, level, (nodes, texts)

    return _mapped(pages, kept, PART_FIELDS, found_in)


def with_first(pages: DataFrame, kinds: Sequence[str], unit: Kind, kept: Sequence[str] = ("page_id",)) -> DataFrame:
    """``kept`` and the ``tree`` of the first element of a kind, NULL where a page has none; reads on no further."""
    listed = frozenset(kinds)

    def found_in(html: str) -> Iterator[tuple]:
        first = next((p for p in scan_parts(html, listed, unit) if p[0] == 0), None)
        yield ((first[3], first[4]) if first else None,)

    return _mapped(pages, kept, [], found_in)


TREE_COLUMN = "tree"


def page() -> Column:
    return F.get(F.col(TREE_COLUMN)["nodes"], F.lit(0))


def unit(n: int = 0) -> Column:
    """The n-th of the elements a part was made for."""
    first = F.get(F.col(TREE_COLUMN)["nodes"], F.lit(1))
    return first if n == 0 else nth(F.filter(F.col(TREE_COLUMN)["nodes"], lambda x: x["parent"] == 0), n)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is found once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def inside(element: Column, tag: str, css_class: str | None = None, starts: bool = False, level: int | None = None) -> Column:
    """All elements of a kind inside another, at any depth, in page order.

    ``css_class`` is one of the element's classes, or with ``starts`` the beginning of one; ``level``
    asks for elements that so many of their own kind enclose.
    """

    def wanted(x: Column) -> Column:
        test = x["tag"] == tag
        if css_class and starts:
            test = test & F.exists(x["classes"], lambda c: c.startswith(css_class))
        elif css_class:
            test = test & F.array_contains(x["classes"], css_class)
        return test if level is None else test & (x["level"] == level)

    def found(one: Column) -> Column:
        nodes = F.slice(F.col(TREE_COLUMN)["nodes"], one["at"] + 2, one["last"] - one["at"])
        return F.when(one.isNotNull(), F.filter(nodes, wanted))

    return bound(element, found)


def children(element: Column, tag: str) -> Column:
    """The elements of a kind directly inside another, among those listed."""
    return bound(element, lambda one: F.filter(inside(one, tag), lambda x: x["parent"] == one["at"]))


def nth(elements: Column, n: int) -> Column:
    return F.get(elements, F.lit(n))


def _texts(start: Column, end: Column) -> Column:
    """The page's texts between two places, as one, trimmed."""
    found = F.slice(F.col(TREE_COLUMN)["texts"], start + 1, end - start)
    return F.regexp_replace(F.array_join(found, ""), r"^\s+|\s+$", "")


def text_of(element: Column) -> Column:
    """The whole text inside an element, trimmed; NULL where there is no element."""
    return bound(element, lambda one: F.when(one.isNotNull(), _texts(one["text_from"], one["text_to"])))


def text_behind(element: Column) -> Column:
    """The text from the end of an element to the end of the one around it, trimmed."""

    def found(one: Column) -> Column:
        around = F.get(F.col(TREE_COLUMN)["nodes"], one["parent"])
        return F.when(one.isNotNull(), _texts(one["text_to"], around["text_to"]))

    return bound(element, found)


def labelled_texts(element: Column, labels: dict[str, str], tag: str = "i") -> Column:
    """A struct of what follows the first element inside another whose text is each label, NULL without one.

    The texts to compare are made once for all labels.
    """

    def behind(found: Column, texts: Column) -> Column:
        at = {name: F.array_position(texts, label).cast("int") - 1 for name, label in labels.items()}
        return F.struct(*[text_behind(F.get(found, place)).alias(name) for name, place in at.items()])

    return bound(inside(element, tag), lambda found: bound(F.transform(found, text_of), lambda texts: behind(found, texts)))


def labelled_text(element: Column, label: str, tag: str = "i") -> Column:
    """What follows the first element inside another whose text is the label; NULL without one."""
    return labelled_texts(element, {"text": label}, tag)["text"]


def attribute(element: Column, name: str) -> Column:
    return element["attrs"][name]
