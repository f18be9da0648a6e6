"""Evaluation texts leaking into a corpus: an FM-index per shard of the corpus.

Both sides are reduced to words (``words``), so layout, case, punctuation,
markup, escapes and invisible characters do not matter. A task turns its
documents into shards. In a shard every word of the test vocabulary is a
symbol; stretches of such words shorter than the shortest phrase can hold no
phrase and are left out, all others are indexed (``fmindex``). All phrases of
``k`` words of all items are searched backwards at once and located; hits with
the same (document, item, offset) that follow each other are exact runs.

How long a phrase is follows from the question, per item of W words with at
most floor(W / 8) replaced: the words left fall into floor(W / 8) + 1 runs, so
the longest has at least ``k`` words, and the phrases hit are at least
``least``. A pair is found

* if a run reaches ``run_words`` (20) words, or
* if it has ``least`` hits and the item, aligned with the document's words
  around them (longest common subsequence), misses no more than the words of
  floor(W / 8) replacements.

For removal every such copy of a pair gets a span, and every run.

Whether a long ``<...>`` is a tag or prose between two signs can't be told. A
text in which it matters has two readings (``readings``): one with markup of any
length blanked, one in which long tags and comments stay as words. Documents
and items are searched in each of their readings, so no passage is lost to
either.

Only the test items are sent to the tasks; documents are not shuffled, a
document with many leaks costs its hits and copies of a document cost what one
does. Items are sent in blocks of ``BLOCK_BYTES`` of text (a block takes some 10
times that in a task, 40 times while the driver builds it), and a task searches its shard's
index once per block, so memory does not grow with the test set; only the words
of the items do, and above ``MOST_WORDS`` of them the rest is searched in
another pass over the corpus.

Defined results: null, empty and wordless texts leak nothing; a null item text
or id is no item; items with equal text are found together; a document row is
answered for itself, each (document, item) once per row. Spans are positions in
the text as given, merged where they overlap or only one character lies between.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from runefold.llm.fmindex import FMIndex

RUN_WORDS, REPLACED = 20, 8
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 4 << 20
#: Different words of the items that one pass over the corpus looks for (some 100 bytes each in a task).
MOST_WORDS = 2_000_000
#: Blocks that a worker keeps between shards.
KEPT_BLOCKS = 2

# Tags of any length and over lines, if every attribute has a value: one of any length without blanks or of a kind that holds no prose, else under 20 words.
_BLANK = r"(?:\s|\\n)"
_VALUE = r"""(?:\\*"[^"\s]*+"|'[^'\s]*+'|\\*"\s*+(?:[^"\s]++\s*+){0,19}"|'\s*+(?:[^'\s]++\s*+){0,19}'|[^\s"'=<>`\\]++)"""
_PLAIN = r"""(?:style|class|d|points|src|srcset|href|transform)\s*+=\s*+(?:\\*"[^"]*+"|'[^']*+')"""
_LONG_TAG = rf"<[A-Za-z][\w:.-]*+(?>{_BLANK}++(?:{_PLAIN}|[A-Za-z_:@][\w:.-]*+\s*+=\s*+{_VALUE}))++{_BLANK}*+/?>"
_LINK = r"|\]\([^()\s]*\)"
_TAG = re.compile(_LONG_TAG + r"|</?[A-Za-z][^<>\n]{0,300}>" + _LINK)
_ANY_TAG = re.compile(_LONG_TAG + r"|</?[A-Za-z][^<>]*>" + _LINK)
#: Longer comments may be prose between two signs that only look like one.
COMMENT = 2000
_CODE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|[ntrbf\"'/])|\\+")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")


def _blank_comments(text: str, most: int | None = None) -> str:
    """Comments, of at most ``most`` characters if given, become blanks; a sign is looked for once, whatever is missing."""
    out, done, at, end = [], 0, text.find("<!--"), -1
    while at >= 0:
        if end < at + 4 and (end := text.find("-->", at + 4)) < 0:
            break
        stop = end + 3
        if most is None or stop - at <= most:
            out += [text[done:at], " " * (stop - at)]
            done = stop
            at = text.find("<!--", stop)
        else:
            at = text.find("<!--", at + 4)
    return "".join(out) + text[done:]


def blank_markup(text: str, long: bool = False) -> str:
    """Tags, comments and link targets become blanks of the same length; ``long`` ones only if asked for."""
    if "<" not in text and "](" not in text:
        return text
    return (_ANY_TAG if long else _TAG).sub(lambda m: " " * len(m[0]), _blank_comments(text, None if long else COMMENT))


def readings(text: str) -> list[str]:
    """The text without markup; twice, if long tags or comments make a difference."""
    one = blank_markup(text)
    if "<" not in text or (other := blank_markup(text, long=True)) == one:
        return [one]
    return [one, other]


def _code(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else " "


def plain_words(text: str) -> list[str]:
    """Words of a text without markup: escapes resolved, invisible characters gone, compatibility forms and case folded."""
    if "\\" in text:
        text = _CODE.sub(_code, text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
    else:
        text = text.lower()
    return _WORD.findall(text)


def words(text: str) -> list[str]:
    return plain_words(blank_markup(text))


def word_places(blanked: str) -> list[tuple[int, int]]:
    """For each word of a reading its place in the text: that of the blank-free piece it comes from."""
    return [m.span() for m in re.finditer(r"\S+", blanked) for _ in plain_words(m[0])]


@dataclass
class Item:
    id: int
    symbols: np.ndarray
    k: int
    least: int
    needed: int


class TestSet:
    """What a task needs of a block of items; its size is theirs. ``vocabulary`` may be shared between blocks."""

    def __init__(self, items: list[tuple], run_words: int = RUN_WORDS, vocabulary: dict[str, int] | None = None):
        self.vocabulary = {} if vocabulary is None else vocabulary
        self.items: list[Item] = []
        windows, uses = [], []
        for id_, blanked in ((i, r) for i, text in items for r in readings(text)):
            w = plain_words(blanked)
            if not w:
                continue
            sizes = [n for n in (len(plain_words(x)) for x in blanked.split()) if n]
            replaced = len(sizes) // REPLACED
            lost = sum(sorted(sizes, reverse=True)[:replaced])  # a replaced word may have held several
            k = min(run_words, max(1, -(-(len(w) - lost) // (replaced + 1))))
            least = max(1, len(w) - lost - (replaced + 1) * (k - 1))
            symbols = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int32)
            windows.append(np.lib.stride_tricks.sliding_window_view(symbols, k))
            uses.append(np.stack([np.full(len(w) - k + 1, len(self.items)), np.arange(len(w) - k + 1)], axis=1))
            self.items.append(Item(id_, symbols.astype(np.int64), k, least, len(w) - lost))
        self.shortest, longest = min((i.k for i in self.items), default=0), max((i.k for i in self.items), default=0)
        rows = np.zeros((sum(map(len, windows)), longest), np.int32)
        at = 0
        for x in windows:
            rows[at : at + len(x), : x.shape[1]] = x
            at += len(x)
        self.phrases, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        order = np.argsort(which, kind="stable")
        self.uses = np.concatenate(uses)[order] if uses else np.zeros((0, 2), np.int64)
        self.use_from = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(self.phrases)), dtype=np.int64)])
        self.top, self.run_words = len(self.vocabulary), run_words

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vocabulary": None}  # sent once, not with every block


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence, a bit per element of ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := masks.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Shard:
    """Index of a stretch of documents.

    ``symbols``: of all words of the shard, 0 outside the vocabulary;
    ``starts``: where each document begins, with the end. Stretches of fewer
    than ``shortest`` vocabulary words are left out.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, shortest: int, top: int):
        self.symbols, self.starts, self.index = symbols, starts, None
        n = len(symbols)
        inside = np.concatenate([[False], symbols != 0, [False]])
        border = np.zeros(n + 1, bool)
        border[starts] = True
        begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
        long_ = end - begin >= shortest
        begin, end = begin[long_], end[long_]
        if len(begin):
            size = end - begin + 1  # a separator after each
            at = np.concatenate([[0], np.cumsum(size)])
            self.source = np.arange(at[-1]) - np.repeat(at[:-1] - begin, size)
            text = symbols[np.minimum(self.source, n - 1)].copy()
            text[at[1:] - 1] = 0
            self.index = FMIndex(text, top)

    def search(self, test: TestSet, every: bool = False) -> list[tuple]:
        """(document, item, first word, word after the last) of each passage found.

        With ``every``, each copy with replaced words is given, also where an
        exact run lies in it; else one is enough for a pair.
        """
        if self.index is None or not len(test.phrases):
            return []
        index, symbols, starts = self.index, self.symbols, self.starts
        low, high = index.find(test.phrases)
        found = np.flatnonzero(high > low)
        times = (high - low)[found]
        if not len(found):
            return []
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        place, phrase = self.source[index.locate(rows)], np.repeat(found, times)
        n_uses = np.diff(test.use_from)[phrase]
        use = np.repeat(test.use_from[phrase] - np.concatenate([[0], np.cumsum(n_uses)[:-1]]), n_uses) + np.arange(n_uses.sum())
        place = np.repeat(place, n_uses)
        item, j = test.uses[use].T
        doc = np.searchsorted(starts, place, side="right") - 1
        offset = place - j
        by = np.lexsort((j, offset, item, doc))
        doc, item, offset, j, place = (x[by] for x in (doc, item, offset, j, place))
        pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        run = pair | np.concatenate([[True], (offset[1:] != offset[:-1]) | (j[1:] != j[:-1] + 1)])
        first = np.flatnonzero(run)
        last = np.append(first[1:], len(doc)) - 1
        k = np.array([i.k for i in test.items])
        length = last - first + k[item[first]]
        whole = length >= np.minimum(test.run_words, np.array([len(i.symbols) for i in test.items]))[item[first]]
        out = [(int(doc[f]), int(item[f]), int(place[f]), int(place[f] + m)) for f, m in zip(first[whole], length[whole])]
        known = {(d, i) for d, i, _, _ in out}
        for a, b in zip(pf := np.flatnonzero(pair), np.append(pf[1:], len(doc))):
            d, i = int(doc[a]), int(item[a])
            want = test.items[i]
            if (not every and (d, i) in known) or len(np.unique(j[a:b])) < want.least:
                continue
            m, slack = len(want.symbols), len(want.symbols) // REPLACED + 1
            o = np.unique(offset[a:b])
            for group in np.split(o, np.flatnonzero(np.diff(o) > slack) + 1):
                x, y = max(int(starts[d]), int(group[0]) - slack), min(int(starts[d + 1]), int(group[-1]) + m + slack)
                if common_length(want.symbols, symbols[x:y]) >= want.needed:
                    mine = place[a:b][np.isin(offset[a:b], group)]
                    out.append((d, i, max(x, int(group[0])), min(y, max(int(group[-1]) + m, int(mine.max()) + want.k))))
                    if not every:
                        break
        return out


def search_shard(test: TestSet, symbols: np.ndarray, starts: np.ndarray, every: bool = False) -> list[tuple]:
    """Index one shard and search one block of items."""
    return Shard(symbols, starts, test.shortest, test.top).search(test, every)


@dataclass
class Pass:
    """The items that one pass over the corpus looks for."""

    vocabulary: Broadcast
    top: int
    blocks: list[Broadcast]
    shortest: int


def _passes(items: DataFrame, id_column: str, text_column: str) -> list[Pass]:
    """All items in blocks, built one at a time: the driver holds a block and the words of one pass."""
    sc = items.sparkSession.sparkContext
    out, vocabulary, blocks, shortest, block, size = [], {}, [], 0, [], 0

    def seal(last: bool) -> None:
        nonlocal vocabulary, blocks, shortest, block, size
        test = TestSet(block, vocabulary=vocabulary)
        if test.items:
            blocks.append(sc.broadcast(test))  # bounded by BLOCK_BYTES, or one item
            shortest = min(shortest or test.shortest, test.shortest)
        block, size = [], 0
        if blocks and (last or len(vocabulary) > MOST_WORDS):
            out.append(Pass(sc.broadcast(vocabulary), len(vocabulary), blocks, shortest))
            vocabulary, blocks, shortest = {}, [], 0

    for id_, text in items.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(id_column, text_column).toLocalIterator():
        block.append((id_, text))
        size += len(text)
        if size >= BLOCK_BYTES:
            seal(False)
    seal(True)
    return out


def passages(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", places: bool = False) -> DataFrame:
    """``id_column, item_id[, start, stop]``: each passage found, in one narrow stage a pass."""
    if id_column.lower() == item_id.lower():
        raise ValueError("documents and items need ids of different names")
    fields = documents.select(id_column).schema[0], items.select(item_id).schema[0]
    kinds, item_kind = [f.dataType.simpleString() for f in fields], to_arrow_type(fields[1].dataType)
    form = f"`{id_column}` {kinds[0]}, `{item_id}` {kinds[1]}" + ", start int, stop int" * places
    texts = documents.select(id_column, text_column)
    found = [texts.mapInArrow(_searching(p, [id_column, item_id, "start", "stop"][: 4 if places else 2], item_kind), form) for p in _passes(items, item_id, item_text)]
    if not found:
        return documents.sparkSession.createDataFrame([], form)
    for other in found[1:]:
        found[0] = found[0].unionAll(other)
    return found[0]


def _searching(sought: Pass, names: list[str], item_kind: pa.DataType):
    """What a task does with its documents."""
    places = len(names) > 2

    def run(batches):
        get = sought.vocabulary.value.get
        schema = None
        ids, rows, texts, parts, n = [], [], [], [], 0

        def flush():
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            shard = Shard(np.concatenate(parts), starts, sought.shortest, sought.top)
            found, at = set(), {}
            for block in sought.blocks:
                test = block.value
                for d, i, a, b in shard.search(test, places):
                    if not places:
                        found.add((rows[d], test.items[i].id))
                        continue
                    if d not in at:
                        at[d] = word_places(texts[d])
                    spans = at[d][a - starts[d] : b - starts[d]]
                    found.add((rows[d], test.items[i].id, spans[0][0], spans[-1][1]))
                if len(sought.blocks) > KEPT_BLOCKS:
                    vars(block).pop("_value", None)  # loaded anew for the next shard
            found = sorted(found)
            columns = [[ids[f[0]] for f in found], *([f[k] for f in found] for k in range(1, len(names)))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], names)

        for b in batches:
            if schema is None:
                schema = [b.column(0).type, item_kind, pa.int32(), pa.int32()]
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                for blanked in readings(text):
                    w = plain_words(blanked)
                    parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
                    rows.append(len(ids))
                    if places:
                        texts.append(blanked)
                    n += len(w)
                ids.append(id_)
                if n >= SHARD_WORDS:
                    yield flush()
                    ids, rows, texts, parts, n = [], [], [], [], 0
        if parts:
            yield flush()

    return run


def leaked(documents: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """``doc_id, item_id`` of every pair."""
    return passages(documents, items, **columns)


def removal_spans(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", **columns: str) -> DataFrame:
    """``id_column, start, stop, n_items``: characters to remove, overlapping passages of a document merged."""
    found = passages(documents, items, id_column=id_column, places=True, **columns)
    item = columns.get("item_id", "item_id")
    from pyspark.sql import Window as W

    w = W.partitionBy(id_column).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = found.withColumn("new", (reach.isNull() | (F.col("start") > reach + 1)).cast("int"))
    return new.withColumn("span", F.sum("new").over(w)).groupBy(id_column, "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.countDistinct(item).cast("int").alias("n_items")).drop("span")
