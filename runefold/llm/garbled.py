"""Text garbled by decoding with the wrong encoding: found, and restored where possible.

A chain is how text gets garbled: written in one encoding, read in another,
perhaps twice, perhaps losing what the second can't read. A multinomial
classifier over hashed byte bigrams of words with characters beyond ASCII tells
for each word how much more likely it is under each chain than as clean text.
It is trained here, on a bounded sample of documents: their words as they are
(*clean*) and garbled by every chain that applies. The sample itself contains
garbled words, so lines that several documents share count once, and a word that
a more frequent word turns into when garbled, that inverts strictly behind UTF-8
to a word of one script (``proven``), however often it occurs, or that holds lost
characters, does not train the clean side. Words that the clean sample holds are
evidence against every chain. Which words and characters a restored passage may
consist of is counted over all documents (``corpus``).

In a line, the stretch of words with the greatest sum of evidence for a chain is
a passage if that sum reaches ``EVIDENCE``. For a lossless chain the passage
must then invert: encode strictly in the wrong encoding, decode strictly in the
true one, and give credible text (``credible``), or be long enough to be beyond
chance (``strict``); else the next best chain is tried. Words within that do not
invert split the passage; those with evidence for the chain count as lost. Chains that
lose bytes need no inversion and are reported as not restorable.

Characters quoted on purpose are no case: inside backticks, or, in a document
whose code encodes or decodes text, alone on a line or in quotes. A passage of
``QUOTED`` characters or more is a quotation only if the document also holds what
it was before.

Defined results: null, empty and ASCII texts are clean; each row is answered
for itself; restored text differs from the given one only in the passages.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runefold.shared import workspace, written

#: Documents the classifier is fitted on, about; the only use of a sample.
SAMPLE_DOCUMENTS = 4000
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Log-likelihood ratio that makes a passage.
EVIDENCE = 6.0
#: How much better, in mean log count, a restored passage must be as clean text.
PLAINER = 0.5
#: Characters behind UTF-8 that don't decode strictly by chance, and how many of them must differ; twice as many where pairs of bytes are read.
LONG, DIFFERENT = 4, 3
PAIRED = ("gb18030", "big5", "cp932")
#: Characters of clean ASCII that end a passage.
GAP = 80
#: Characters that a longer passage than a quotation takes from first to last beyond ASCII.
QUOTED = 16
#: Words kept with their scores in a worker.
CACHE_WORDS = 200_000

REPLACEMENT = "�"


@dataclass(frozen=True)
class Chain:
    true: str
    wrong: str
    rounds: int = 1
    loss: str = ""  # "", "replace" or "drop": what happens to bytes the wrong encoding lacks

    @property
    def name(self) -> str:
        return f"{self.true}>{self.wrong}" + f"x{self.rounds}" * (self.rounds > 1) + f" {self.loss}" * bool(self.loss)

    def garble(self, text: str) -> str | None:
        """The garbled text, or None where the chain does not apply to it."""
        try:
            for _ in range(self.rounds):
                text = _read(text.encode(self.true), self.wrong, self.loss)
        except UnicodeError:
            return None
        return text

    def garble_all(self, words: list[str]) -> list[str | None]:
        """``garble`` of each word; many at a time where all of a block can be written."""
        out: list[str | None] = []
        for i in range(0, len(words), 64):
            part = words[i : i + 64]
            whole = self.garble("\n".join(part))
            done = whole.split("\n") if whole is not None else []
            out += done if len(done) == len(part) else map(self.garble, part)
        return out

    def possible(self, text: str) -> bool:
        """For lossy chains: whether the text can be what they leave."""
        try:
            _write(text.replace(REPLACEMENT, ""), self.wrong if self.wrong != "ascii" else "latin-1")
        except UnicodeError:
            return False
        if self.loss == "replace":
            return REPLACEMENT in text
        return any("\xc2" <= c <= "\xf4" for c in text)  # the readings of the first bytes in UTF-8

    def invert(self, text: str) -> str | None:
        """The original by strict decoding, or None."""
        if self.loss:
            return None
        try:
            for _ in range(self.rounds):
                text = _write(text, self.wrong).decode(self.true)
        except UnicodeError:
            return None
        return text


_CONTROLS = re.compile("[\x80-\x9f]")
# Bytes that windows-1252 leaves undefined; readers commonly pass them through as controls.
_UNDEFINED_1252 = {b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TABLE_1252 = "".join(_UNDEFINED_1252.get(b) or bytes([b]).decode("cp1252") for b in range(256))
_BACK_1252 = codecs.charmap_build(_TABLE_1252)


def _read(data: bytes, encoding: str, loss: str) -> str:
    if encoding == "cp1252" and loss != "replace":
        text = codecs.charmap_decode(data, "strict", _TABLE_1252)[0]
    else:
        text = data.decode(encoding, "replace" if loss == "replace" else "strict")
    return _CONTROLS.sub("", text) if loss == "drop" else text


def _write(text: str, encoding: str) -> bytes:
    if encoding != "cp1252":
        return text.encode(encoding)
    return codecs.charmap_encode(text, "strict", _BACK_1252)[0]


def chains() -> list[Chain]:
    legacy = ["cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866"]
    out = [Chain("utf-8", w) for w in ("latin-1", "cp1252", "cp1254", *legacy, "gb18030", "big5", "cp932")]
    out += [Chain("utf-8", "cp1252", 2), Chain("utf-8", "latin-1", 2), Chain("utf-8", "cp1252", 3), Chain("utf-8", "cp1250", 2), Chain("utf-8", "cp1251", 2)]
    out += [Chain("utf-8", w, 1, "replace") for w in ("ascii", "cp1252", "gb18030", "big5", "cp932")]
    out += [Chain("utf-8", w, 1, "drop") for w in ("latin-1", "cp1252")] + [Chain("utf-8", "cp1252", 2, "drop")]
    out += [Chain("cp1252", w) for w in (*legacy, "gb18030", "cp932")] + [Chain("cp1252", w, 1, "replace") for w in ("gb18030", "cp932")]
    for true in ("cp1250", "cp1254", "cp1251", "koi8-r", "cp866", "cp850", "cp437", "mac_roman"):
        out.append(Chain(true, "cp1252"))
    out += [Chain(true, wrong) for true in ("iso8859-2", "cp852") for wrong in ("cp1252", "latin-1")] + [Chain(true, "cp1252") for true in ("iso8859-5", "mac_cyrillic")]
    out += [Chain(true, "utf-8", 1, "replace") for true in ("cp1252", "cp1250", "cp1254", "cp1251", "koi8-r", "shift_jis", "euc_jp", "gbk", "big5")]
    out += [Chain(a, b) for a in ("cp1251", "koi8-r", "cp866") for b in ("cp1251", "koi8-r", "cp866", "mac_roman", "cp437") if a != b]
    for true in ("shift_jis", "euc_jp", "gbk", "big5"):
        out.append(Chain(true, "cp1252"))
    out += [Chain(a, b, 1, "replace") for a, b in (("shift_jis", "gb18030"), ("gbk", "cp932"), ("euc_jp", "cp932"), ("gbk", "big5"), ("big5", "gb18030"))]
    return out


CHAINS = chains()
_WORD = re.compile(r"[^ \t\r\n]+")
_SPLIT = re.compile(r"[ \t\r\n]+")
_LINE = re.compile(r"\n|\\n")


def line_words(line: str) -> list[tuple[int, int]]:
    """Places of the blank-separated words with characters beyond ASCII; no-break spaces do not separate."""
    return [m.span() for m in _WORD.finditer(line) if not m[0].isascii()]


_ENDS = re.compile(r"^[\x00-@\[-`{-\x7f]+|[\x00-@\[-`{-\x7f]+$")


def form(word: str) -> str:
    """A word without the ASCII punctuation and digits at its ends."""
    return _ENDS.sub("", word)


def _broken(word: str) -> bool:
    """Lost characters, controls or private use: no clean word."""
    return REPLACEMENT in word or bool(_CONTROLS.search(word)) or any("\ue000" <= c <= "\uf8ff" for c in word)


@cache
def _script(c: str) -> str:
    """Script of a letter, "" of other characters, "?" where no text has the character."""
    kind = unicodedata.category(c)
    if kind in ("Cn", "Co", "Cs", "Cc"):
        return "?"
    first = unicodedata.name(c, "?").split()[0].split("-")[0] if kind[0] == "L" else ""
    return "CJK" if first in ("HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC") else first


def proven(word: str) -> bool:
    """Whether a word inverts strictly behind UTF-8 to letters of one script, so that only garbling explains it.

    Pairs of bytes, as in the East Asian encodings, decode by chance more often; there it takes three characters.
    """
    for chain in CHAINS:
        if chain.true != "utf-8" or chain.loss or (back := chain.invert(word)) is None or back == word:
            continue
        scripts = set(map(_script, back)) - {""}
        if len(scripts) < 2 and "?" not in scripts and (chain.wrong not in PAIRED or sum(c > "\x7f" for c in back) > 2 and "CJK" in map(_script, word)):
            return True
    return False


#: Formatting characters are no evidence by themselves: no-break spaces count as blanks, the rest not at all.
_FORMAT = {0xA0: " ", 0x202F: " ", 0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None}


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte bigram that touches a byte beyond ASCII, and the word it belongs to."""
    coded = [w.translate(_FORMAT).encode() for w in words]
    data = np.frombuffer(b" " + b" ".join(coded) + b" ", np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(coded)), [len(w) + 1 for w in coded])
    a, b = data[:-1], data[1:]
    use = (a | b) >= 128
    return ((a << 8 | b) * np.uint32(40503) >> np.uint32(1) & np.uint32(BUCKETS - 1)).astype(np.int64)[use], owner[use]


def _sums(table: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per word the sum of its buckets' rows, and their number."""
    at, owner = buckets(words)
    out = np.zeros((len(words), *table.shape[1:]), table.dtype)
    n = np.bincount(owner, minlength=len(words))
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] = np.add.reduceat(table[at], first, axis=0)
    return out, n


def _histogram(counted: dict[str, int]) -> np.ndarray:
    if not counted:
        return np.zeros(BUCKETS)
    at, owner = buckets(list(counted))
    return np.bincount(at, np.array(list(counted.values()), float)[owner], BUCKETS)


class Classifier:
    """Evidence of each chain against clean text, per bucket.

    ``table``: log of the ratio of what garbling the whole sample would yield
    in a bucket to what clean text yields; ``clean``: log of the latter;
    ``lexicon``: the sample's clean words beyond ASCII, case folded; ``usual``:
    characters outside of broken words; ``suspect``: the sample's words that are
    no clean ones; ``vocabulary``: table of the hashes of all documents' words,
    which stays on the cluster; ``held``: those of them that the text in hand asks for.
    """

    def __init__(self, table: np.ndarray, clean: np.ndarray, lexicon: frozenset, usual: frozenset, suspect: frozenset = frozenset(), vocabulary: DataFrame | None = None):
        self.table, self.clean, self.lexicon, self.usual, self.suspect, self.vocabulary = table, clean, lexicon, usual, suspect, vocabulary
        self.held: frozenset[int] = frozenset()
        self.cache: dict[str, np.ndarray] = {}

    @classmethod
    def fit(cls, texts: list[str]) -> Classifier:
        counts: dict[str, int] = {}
        lines: set[str] = set()
        often: dict[str, int] = {}
        for t in sorted(set(texts)):  # copies count once, in ``counts`` also lines that several texts share
            for w in {form(w) for w in _WORD.findall(t) if not w.isascii()}:
                often[w] = often.get(w, 0) + 1
            new = {x for x in _LINE.split(t) if not x.isascii()} - lines
            lines |= new
            for w in {form(w) for x in new for w in _WORD.findall(x) if not w.isascii()}:
                counts[w] = counts.get(w, 0) + 1
        words = {w: n for w, n in counts.items() if not _broken(w)}
        seen: dict[str, int] = {}
        for w, n in words.items():
            for c in set(w):
                seen[c] = seen.get(c, 0) + n
        # A word that another, more frequent one turns into when garbled is no clean word, nor is a proven one, however frequent.
        made = [{} for _ in CHAINS]
        suspect = {w for w in words if proven(w)}
        alike = sorted(words, key=lambda w: (max(w), w))  # neighbours share a script, so blocks can be written as wholes
        for i, c in enumerate(CHAINS):
            for w, g in zip(alike, c.garble_all(alike)):
                if g and g != w and not g.isascii():
                    made[i][g] = w
                    if (m := words.get(g)) is not None and (m < words[w] or often.get(g, 0) < often.get(w, 0)):
                        suspect.add(g)
        lexicon = frozenset(w.casefold() for w, n in words.items() if n > 1 and w not in suspect)
        words = {w: often.get(w, n) for w, n in words.items() if w not in suspect}
        clean = np.log(_histogram(words) + SMOOTHING)
        table = np.stack([np.log(_histogram({g: words[w] for g, w in m.items() if w in words}) + SMOOTHING) for m in made], axis=1) - clean[:, None]
        return cls(table.astype(np.float32), clean.astype(np.float32), lexicon, frozenset(c for c, n in seen.items() if n > 2), frozenset(suspect))

    def known(self, word: str) -> bool:
        return form(word).casefold() in self.lexicon

    def vouched(self, word: str) -> bool:
        """Whether the sample or the other documents hold the word."""
        return self.known(word) or _hash(form(word).casefold()) in self.held

    def strict(self, chain: Chain, restored: str, given: str) -> bool:
        """Whether a passage behind UTF-8 is long enough that strict decoding alone proves it, whatever its characters."""
        if chain.true != "utf-8":
            return False
        old = set(_SPLIT.split(given))
        new = [w for w in _SPLIT.split(restored) if w and not w.isascii()]
        changed = [w for w in new if w not in old]
        chars = [c for w in changed for c in w if c > "\x7f"]
        times = 1 + (chain.wrong in PAIRED)
        return len(changed) * 2 >= len(new) and len(chars) >= LONG * times and len(set(chars)) >= DIFFERENT * times and "?" not in map(_script, chars) and (times == 1 or "CJK" in map(_script, given))

    def credible(self, chain: Chain, restored: str, given: str) -> bool:
        """Whether a strictly decoded passage is what was written.

        Behind UTF-8, decodability is a proof for all but short words, so three
        usual characters in four suffice. Between encodings of one byte a character anything
        decodes: half of the changed words with letters must be known, or, in
        scripts without blanks, the passage must be better clean text.
        """
        new = [w for w in _SPLIT.split(restored) if w and not w.isascii()]
        old = set(_SPLIT.split(given))
        if chain.true == "utf-8":
            beyond = [c for c in restored if ord(c) > 127]
            return sum(c in self.usual for c in beyond) >= 0.75 * len(beyond)
        changed = [w for w in new if w not in old and sum(map(str.isalpha, form(w))) > 1]
        if any(self.vouched(w) for w in changed):
            return sum(map(self.vouched, changed)) * 2 >= len(changed)
        if sum(c >= "\u2e80" for w in changed for c in w) < 4:
            return False
        total, n = _sums(self.clean, [restored, given])
        return bool(n[0]) and total[0] / n[0] > total[1] / max(1, n[1]) + PLAINER

    def table_scores(self, words: list[str]) -> np.ndarray:
        return _sums(self.table, words)[0]

    def scores(self, words: list[str]) -> list[np.ndarray]:
        """Evidence per chain of each word."""
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {}
            new = list(dict.fromkeys(words))
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            found = self.table_scores([form(w) for w in part])
            for w, x in zip(part, found):
                self.cache[w] = np.minimum(x, -1.0) if self.known(w) else x
        return [self.cache[w] for w in words]

    def _lines(self, text: str):
        """``(place, line, places of its words, their evidence)`` of the lines with evidence for any chain."""
        at = 0
        for m in (*_LINE.finditer(text), None):
            line, start, at = text[at : m.start() if m else len(text)], at, m.end() if m else len(text)
            if line.isascii():
                continue
            places = line_words(line)
            rows = self.scores([line[a:b] for a, b in places])
            if max(float(r.max()) for r in rows) > 0:
                yield start, line, places, np.stack(rows)

    def asked(self, text: str) -> set[int] | None:
        """Hashes of the words that ``passages`` may ask ``vouched`` about; None if the text can hold no passage.

        A chain reaches ``EVIDENCE`` in part of a stretch only if it does in the whole, so no word is left out.
        """
        if not text or text.isascii():
            return None
        out, possible = set(), False
        for _, line, places, rows in self._lines(text):
            for low, high in _stretches(places, rows, 0, len(places)):
                top, _ = _tops(places, rows, low, high)
                for c in np.flatnonzero(top >= EVIDENCE):
                    possible, chain = True, CHAINS[c]
                    if not chain.loss and chain.true != "utf-8":
                        for a, b in places[low:high]:
                            out.update(_hash(form(w).casefold()) for w in _SPLIT.split(chain.invert(line[a:b]) or "") if w and not w.isascii())
        return out if possible else None

    def passages(self, text: str) -> list[tuple[int, int, Chain, str | None]]:
        """(start, stop, chain, restored or None) of each garbled passage."""
        if not text or text.isascii():
            return []
        found, lesson = [], None
        for start, line, places, rows in self._lines(text):
            for a, b, chain, back in self._in_line(line, places, rows):
                if _in_backticks(line, a, b):
                    continue
                if lesson is None:
                    lesson = bool(re.search(r"\.(?:de|en)code\(", text))
                if lesson and _alone(line, a, b) and (_short(line, a, b) or back is not None and back in text):
                    continue
                found.append((start + a, start + b, chain, back))
        return found

    def _in_line(self, line: str, places: list, rows: np.ndarray) -> list:
        """Passages of a line, best first in each stretch; what is left beside one is searched again."""
        out, open_ = [], _stretches(places, rows, 0, len(places))
        while open_:
            low, high = open_.pop()
            best = self._best(line, places, rows, low, high)
            if best is None:
                continue
            i, j, pieces = best
            out += pieces
            for x, y in ((low, i), (j + 1, high)):
                if x < y:
                    open_ += _stretches(places, rows, x, y)
        return out

    def _best(self, line: str, places: list, rows: np.ndarray, low: int, high: int) -> tuple | None:
        """``(first word, last word, pieces)`` of the passage with most evidence that holds; None if there is none."""
        top, span = _tops(places, rows, low, high)
        proof = None
        for c in np.argsort(-top):
            if top[c] < EVIDENCE:
                break
            i, j = (int(x) for x in span[c])
            a, b = places[i][0], places[j][1]
            chain = CHAINS[c]
            if chain.loss:
                if proof:
                    break
                if not chain.possible(line[a:b]):
                    continue
                return i, j, [(a, b, chain, None)]
            pieces = restore(line, places[i : j + 1], chain, rows[i : j + 1, c])
            if pieces is None:
                continue
            back = "".join(line[x:y] if new is None else new for x, y, new in _filled(pieces, a, b))
            found = i, j, [(x, y, chain, new) for x, y, new in pieces]
            if self.credible(chain, back, line[a:b]):
                return found
            if not proof and self.strict(chain, back, line[a:b]):
                proof = found  # unless another chain gives usual text
        return proof


def _tops(places: list, rows: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Per chain the greatest sum of evidence of neighbouring words, and their first and last."""
    n_chains = rows.shape[1]
    run, begin = np.zeros(n_chains), np.full(n_chains, low)
    top, span = np.zeros(n_chains), np.zeros((n_chains, 2), int)
    for i in range(low, high):
        new = run <= 0
        if i > low and places[i][0] - places[i - 1][1] > GAP:
            new[:] = True
        begin[new] = i
        run = np.where(new, 0, run) + rows[i]
        better = run > top
        top[better] = run[better]
        span[better, 0], span[better, 1] = begin[better], i
    return top, span


def _stretches(places: list, rows: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Stretches of words that no passage leaves: behind their last word the evidence of every chain is used up, or a gap follows."""
    out, run, start = [], np.zeros(rows.shape[1]), None
    for i in range(low, high):
        if start is not None and places[i][0] - places[i - 1][1] > GAP:
            out.append((start, i))
            start, run = None, np.zeros(rows.shape[1])
        run = np.maximum(run, 0) + rows[i]
        if (run > 0).any():
            start = i if start is None else start
        elif start is not None:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, high))
    return out


def _filled(pieces: list, a: int, b: int):
    """The pieces of a passage with the unchanged text between them."""
    for x, y, new in pieces:
        if a < x:
            yield a, x, None
        yield x, y, new
        a = y
    if a < b:
        yield a, b, None


def restore(line: str, places: list, chain: Chain, evidence: np.ndarray | None = None) -> list[tuple[int, int, str | None]] | None:
    """``(start, stop, original)`` of each piece of a passage; None if no word inverts strictly to another.

    A piece is a run of words that invert strictly, checked as a whole. A word
    that does not is left as it is; with evidence for the chain it is a lost
    piece (original None), else it belongs to no piece.
    """
    inverted = [chain.invert(line[i:j]) for i, j in places]
    if not any(new is not None and new != line[i:j] for (i, j), new in zip(places, inverted)):
        return None
    out, k = [], 0
    while k < len(places):
        if inverted[k] is None:
            if evidence is not None and evidence[k] > 0:
                out.append((*places[k], None))
            k += 1
            continue
        m = k
        while m + 1 < len(places) and inverted[m + 1] is not None:
            m += 1
        while (whole := chain.invert(line[places[k][0] : places[m][1]])) is None:
            m -= 1  # the blanks between do not invert: a shorter run
        if whole != line[places[k][0] : places[m][1]]:
            out.append((places[k][0], places[m][1], whole))
        k = m + 1
    return out


def _in_backticks(line: str, a: int, b: int) -> bool:
    """Whether every character beyond ASCII of the passage stands in backticks."""
    quoted = [m.span() for m in re.finditer(r"`[^`]*`", line)]
    return bool(quoted) and all(any(i <= k < j for i, j in quoted) for k in range(a, b) if ord(line[k]) > 127)


def _short(line: str, a: int, b: int) -> bool:
    beyond = [k for k in range(a, b) if ord(line[k]) > 127]
    return beyond[-1] - beyond[0] < QUOTED


def _alone(line: str, a: int, b: int) -> bool:
    """Whether nothing else is on the line (no two ASCII letters in a row), or in the quotes around the characters."""
    beyond = [k for k in range(a, b) if ord(line[k]) > 127]
    before, after = line[max(0, beyond[0] - 2) : beyond[0]], line[beyond[-1] + 1 : beyond[-1] + 3]
    quoted = _short(line, a, b) and re.search(r"""["']""", before) and re.search(r"""["']""", after)
    return bool(quoted) or not re.search(r"[A-Za-z]{2}", line)


def fit(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE_DOCUMENTS) -> Classifier:
    """Classifier from about ``sample`` documents, chosen by a hash of their id."""
    n = documents.count()
    share = min(1.0, sample / max(1, n))
    chosen = documents.where(F.col(text_column).isNotNull())
    if share < 1:
        chosen = chosen.where((F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < int(share * (1 << 30))))
    # Only words beyond ASCII matter for the fit, and only of the sample: bounded by the parameter.
    texts = [r[0] for r in chosen.select(text_column).limit(2 * sample).toLocalIterator()]
    model = Classifier.fit([t for t in texts if not t.isascii()])
    model.usual, model.vocabulary = corpus(documents, model, text_column)
    return model


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def corpus(documents: DataFrame, model: Classifier, text_column: str = "text") -> tuple[frozenset, DataFrame]:
    """The characters more than two documents hold, and a table ``h`` of the hashes of the words, case folded, more than one holds.

    Counted over all distinct texts, without broken, proven and suspect words. A
    batch of rows hands on as many texts of a word or character as decide. Only
    characters come to the driver; there are no more than Unicode has.
    """
    spark = documents.sparkSession
    kept = spark.sparkContext.broadcast(model.suspect)  # bounded by the sample

    def count(batches):
        suspect, clean = kept.value, {}
        for b in batches:
            texts: dict[tuple[bool, str], set[int]] = {}
            for text in b.column(0).to_pylist():
                own, at = set(), _hash(text)
                for w in {form(w) for w in _WORD.findall(text.replace("\\n", "\n")) if not w.isascii()}:
                    if w not in clean:
                        if len(clean) >= CACHE_WORDS:
                            clean.clear()
                        clean[w] = not (_broken(w) or w in suspect or proven(w))
                    if clean[w]:
                        own |= {(True, w.casefold()), *((False, c) for c in set(w))}
                for key in own:
                    if len(have := texts.setdefault(key, set())) < 3:
                        have.add(at)
            rows = [(k[0], _hash(k[1]) if k[0] else ord(k[1]), at) for k, v in texts.items() for at in v]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.int64()))], ["word", "key", "text"])

    beyond = documents.where(F.col(text_column).rlike(r"[^\x00-\x7F]")).select(text_column)
    n = beyond.mapInArrow(count, "word boolean, key long, text long").distinct().groupBy("word", "key").count()
    found = written(n.where(F.when(F.col("word"), F.col("count") > 1).otherwise(F.col("count") > 2)).select("word", "key"), workspace(spark, "words"))
    usual = {chr(r[0]) for r in found.where("not word").select("key").toLocalIterator()}
    return model.usual | usual, found.where("word").select(F.col("key").alias("h"))


def candidates(documents: DataFrame, table, id_column: str, text_column: str) -> DataFrame:
    """``row, id, text, asked``: the documents that can hold a passage, and the words their restoration depends on."""
    kind = documents.select(id_column).schema[0].dataType.simpleString()

    def run(batches):
        own = Classifier(*table.value)
        for b in batches:
            found = [(i, text, sorted(asked)) for i, text in enumerate(b.column(1).to_pylist()) if (asked := own.asked(text)) is not None]
            ids = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["id", "text", "asked"])

    found = documents.select(id_column, text_column).mapInArrow(run, f"id {kind}, text string, asked array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def garbled(documents: DataFrame, model: Classifier, id_column: str = "doc_id", text_column: str = "text", restored: bool = False) -> DataFrame:
    """``id_column`` of each document with a garbled passage; with ``restored`` also ``chains, n_passages, n_lost, text``.

    Documents that can hold one are written; the words that decide are looked
    up by a join with the vocabulary, which is as large as the corpus makes it.
    """
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast((model.table, model.clean, model.lexicon, model.usual, model.suspect))  # bounded by BUCKETS, chains, the sample and Unicode
    kind = documents.select(id_column).schema[0].dataType.simpleString()
    possible = written(candidates(documents, table, id_column, text_column), workspace(spark, "candidates"))
    asked = possible.select("row", F.explode("asked").alias("h"))
    if model.vocabulary is None:
        asked = asked.limit(0)
    else:
        asked = asked.join(model.vocabulary.hint("merge"), "h", "left_semi")
    held = asked.groupBy("row").agg(F.collect_list("h").alias("held"))  # a text's own words
    decided = possible.join(held.hint("merge"), "row", "left").select("id", "text", "held")

    def run(batches):
        own = Classifier(*table.value)
        for b in batches:
            out = [[], [], [], [], []]
            for id_, text, held in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own.held = frozenset(held or ())
                if not (found := own.passages(text)):
                    continue
                out[0].append(id_)
                if restored:
                    parts, at = [], 0
                    for a, z, _, back in sorted(found, key=lambda f: f[:2]):
                        parts += [text[at:a], text[a:z] if back is None else back]
                        at = z
                    out[1].append(sorted({f[2].name for f in found}))
                    out[2].append(len(found))
                    out[3].append(sum(f[3] is None for f in found))
                    out[4].append("".join(parts) + text[at:])
            ids = pa.array([x.as_py() for x in out[0]], b.column(0).type)
            if restored:
                yield pa.RecordBatch.from_arrays([ids, pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.string())], [id_column, "chains", "n_passages", "n_lost", "text"])
            else:
                yield pa.RecordBatch.from_arrays([ids], [id_column])

    form = f"`{id_column}` {kind}" + ", chains array<string>, n_passages int, n_lost int, text string" * restored
    return decided.mapInArrow(run, form)
