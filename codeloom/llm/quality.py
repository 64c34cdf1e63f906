"""Per-document text quality and a learned rule list that tells natural prose from the rest.

Figures come from one pass over the characters of a batch of whole texts, with
array operations.  But for two they need no knowledge of a language: they
describe words, symbols, lines and sentences by their shape.  The two tell how
much of a text is words that are common in the corpus itself: a word is common
if it stands in at least ``COMMON_IN`` of the documents of one language, which is
counted over all documents.

An ordered list of rules is induced from labelled documents by incremental
reduced-error pruning: a rule is grown condition by condition on two thirds of
the documents, pruned on the rest, and kept while it is right more often than
not; what it covers is taken out and the next rule is grown.  A rule needs two
witnesses, known words and layout: the second is the condition that keeps most of
what the rule covers and excludes most prose at large.  So well-formed prose in a
language that the corpus doesn't know is no case, and neither is careless prose
in one that it does.  The list becomes one SQL CASE expression that the engine
applies like any other column.

Defined results: null, empty and blank texts have zeros as figures and are no
cases; labels are compared trimmed and without regard to case; documents with
no label, another label or contradicting labels aren't learned from; without
labels of both kinds there are no rules and no cases; at most ``sample_rows``
labelled documents, chosen by a hash of their ids, are learned from.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.normal import filled, norm_id
from codeloom.session import materialize, release, ship, spread

FIGURES = (
    "words", "mean_word", "longest_word", "unique_share", "name_share", "symbol_share", "digit_share", "upper_share", "wide_share",
    "lines", "words_per_line", "line_spread", "ending_lines", "gap_share", "sentence_share", "common_share", "known_share",
)
#: The two witnesses of a rule: figures of known words, and figures that tell sentences from other layouts in any language.
KNOWN = ("common_share", "known_share")
LAYOUT = ("sentence_share", "ending_lines", "symbol_share", "digit_share", "gap_share", "name_share", "words_per_line", "line_spread")
KNOWN_LINE = 0.2  # share of common words from which a line counts as one of known words
COMMON_IN, COMMON_LEAST = 0.4, 5  # share of a language's documents, and documents, that a common word stands in

# ---------------------------------------------------------------- characters

_NONE, _LOWER, _UPPER, _DIGIT, _JOIN, _WIDE, _SYMBOL, _CLOSE, _END, _SPACE, _LINE = range(11)
_TOP = 0x20000
#: Characters that end a sentence, those that may follow an end, and pauses inside a sentence.
_ENDS, _WIDE_ENDS, _CLOSERS, _PAUSES = ".!?…؟।։።", "。！？｡", "\"'”’»)]*_`」』）", ",;、，；،"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each character; what lies above the two first planes is wide up to plane 3."""
    kind, low = np.zeros(_TOP + 1, np.uint8), np.arange(_TOP + 1, dtype=np.uint32)
    by = {"Lu": _UPPER, "Lt": _UPPER, "Zs": _SPACE, "Zl": _LINE, "Zp": _LINE}
    first = {"L": _LOWER, "M": _LOWER, "N": _DIGIT, "P": _SYMBOL, "S": _SYMBOL}
    for c in range(_TOP):
        x = chr(c)
        cat = unicodedata.category(x)
        kind[c] = by.get(cat) or first.get(cat[0], _NONE)
        if cat == "Lu" and len(x.lower()) == 1:
            low[c] = ord(x.lower())
    for a, b in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00)):
        part = kind[a:b]
        part[part == _LOWER] = _WIDE
    kind[_TOP] = _WIDE
    for chars, k in ((_CLOSERS, _CLOSE), (_ENDS + _WIDE_ENDS, _END), ("_", _JOIN), ("\t", _SPACE), ("\n\x0b\x0c\x85", _LINE)):
        kind[[ord(c) for c in chars]] = k
    return kind, low


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters its input."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Read:
    """Characters of a batch of texts: classes, where texts and words start and end, and a hash of each word in lower case."""

    kind: np.ndarray
    code: np.ndarray
    start: np.ndarray
    first: np.ndarray
    last: np.ndarray
    word: np.ndarray
    doc: np.ndarray

    def once(self) -> np.ndarray:
        """The place of one of each text's equal words."""
        return np.unique(_mix(self.word ^ _mix(self.doc.astype(np.uint64) + np.uint64(1))), return_index=True)[1]


def read_texts(texts: list[str]) -> Read:
    kinds, lows = _tables()
    whole = "".join(t.replace("\r\n", "\n").replace("\r", "\n") + "\n\n" for t in texts)
    code = np.minimum(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), _TOP)
    kind = kinds[code]
    sizes = np.array([len(t) - t.count("\r\n") + 2 for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    wide = kind == _WIDE
    inside = (kind >= _LOWER) & (kind <= _JOIN) | (code == ord("_"))
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first, last = np.flatnonzero(inside & ~before | wide), np.flatnonzero(inside & ~after | wide) + 1
    size = last - first
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        chars = lows[code[np.repeat(first, size) + at]].astype(np.uint64)
        hashed = _mix(chars * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64))
        word = np.add.reduceat(hashed, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
    return Read(kind, code, start, first, last, word, np.searchsorted(start, first, "right") - 1)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.floor(np.divide(a, b, out=np.zeros(len(b)), where=b > 0) * 1e4 + 0.5) / 1e4


def measure(texts: list[str], common: np.ndarray, want: tuple[str, ...] = FIGURES) -> dict[str, np.ndarray]:
    """The figures ``want`` and lines of each text; ``common`` holds sorted hashes of words."""
    n = len(texts)
    if not n:
        return {f: np.zeros(0) for f in (*want, "lines")}
    r = read_texts(texts)
    k, idx = r.kind, np.arange(len(r.kind))
    total = lambda flag: np.add.reduceat(flag, r.start, dtype=np.int64).astype(float)
    per = lambda rows, weights=None: np.bincount(rows, weights, n).astype(float)
    solid_at = (k != _SPACE) & (k != _LINE) & (k != _NONE)
    letter = (k == _LOWER) | (k == _UPPER) | (k == _WIDE)
    digit, line_at = k == _DIGIT, k == _LINE
    solid, letters = total(solid_at), total(letter)
    symbols = total(((k == _SYMBOL) | (k == _CLOSE)) & ~np.isin(r.code, [ord(c) for c in _PAUSES + "_"]))
    # words
    size = (r.last - r.first).astype(float)
    words = per(r.doc)
    longest = np.zeros(n)
    if "longest_word" in want and len(size):
        some, at = np.unique(r.doc, return_index=True)
        longest[some] = np.maximum.reduceat(size, at)
    once = r.once() if "unique_share" in want else np.zeros(0, np.int64)
    inner = np.zeros(len(k), bool)
    inner[1:] = (k[1:] == _UPPER) & (k[:-1] == _LOWER)
    inner |= r.code == ord("_")
    named = np.unique(np.searchsorted(r.first, np.flatnonzero(inner), "right") - 1)
    named = named[named >= 0]
    hit = np.zeros(len(r.word), bool)
    if len(common) and len(r.word):
        hit = common[np.minimum(np.searchsorted(common, r.word), len(common) - 1)] == r.word
    # lines
    ends = np.flatnonzero(line_at)
    begin = np.concatenate([[0], ends[:-1] + 1])
    solids = np.concatenate([[0], np.cumsum(solid_at)])
    held = solids[ends] - solids[begin]
    row = held > 0
    of = np.searchsorted(r.start, begin, "right") - 1
    last_said = np.maximum.accumulate(np.where(solid_at & (k != _CLOSE), idx, -1))
    spelt = np.concatenate([[0], np.cumsum(letter)])
    closed = row & (2 * (spelt[ends] - spelt[begin]) >= held) & (last_said[np.maximum(ends - 1, 0)] >= begin) & (k[np.maximum(last_said[np.maximum(ends - 1, 0)], 0)] == _END)
    lines, ending = per(of[row]), per(of[closed])
    line_of = np.searchsorted(begin, r.first, "right") - 1
    line_words, line_hits = np.bincount(line_of, minlength=len(begin)), np.bincount(line_of, hit, len(begin))
    known = np.where((line_hits > 0) & (line_hits >= KNOWN_LINE * line_words), held, 0)
    mean, square = per(of[row], held[row]), per(of[row], held[row].astype(float) ** 2)
    m = np.divide(mean, lines, out=np.zeros(n), where=lines > 0)
    spread_ = np.sqrt(np.maximum(np.divide(square, lines, out=np.zeros(n), where=lines > 0) - m * m, 0.0))
    gap = _gaps(r, solid_at) if {"gap_share", "sentence_share"} & {*want} else np.zeros(len(k), bool)
    told = _told(r, solid_at, letter, gap, begin, ends, row, n) if "sentence_share" in want else np.zeros(n)
    out = {
        "words": words, "mean_word": _share(per(r.doc, size), words), "longest_word": longest, "unique_share": _share(per(r.doc[once]), words),
        "name_share": _share(per(r.doc[named]), words), "symbol_share": _share(symbols, solid), "digit_share": _share(total(digit), solid),
        "upper_share": _share(total(k == _UPPER), letters), "wide_share": _share(total(k == _WIDE), letters), "lines": lines, "words_per_line": _share(words, lines),
        "line_spread": _share(spread_, m), "ending_lines": _share(ending, lines), "gap_share": _share(total(gap), words), "sentence_share": _share(told, solid),
        "common_share": _share(per(r.doc[hit]), words), "known_share": _share(per(of, known), solid),
    }
    return {f: out[f] for f in (*want, "lines")}


def _gaps(r: Read, solid_at: np.ndarray) -> np.ndarray:
    """Where wide gaps between what stands on one line end."""
    k, idx = r.kind, np.arange(len(r.kind))
    gap = np.zeros(len(k), bool)
    gap[2:] = (k[2:] != _SPACE) & (k[2:] != _LINE) & (k[1:-1] == _SPACE) & (k[:-2] == _SPACE)
    gap[1:-1] |= (r.code[1:-1] == 9) & (k[:-2] != _LINE) & (k[2:] != _LINE)
    at = np.flatnonzero(gap)
    led = np.maximum.accumulate(np.where(k == _LINE, idx, -1))[at]
    said = np.maximum.accumulate(np.where(solid_at, idx, -1))[np.maximum(at - 2, 0)]
    gap[at] = said > led
    return gap


def _told(r: Read, solid_at: np.ndarray, letter: np.ndarray, gap: np.ndarray, begin: np.ndarray, ends: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Characters of each text in sentences: what an end closes, cut at blank lines (lines from begin to ends; row: not blank)."""
    k = r.kind
    nxt = np.full(len(k), _LINE, np.uint8)
    nxt[:-1] = k[1:]
    stop = k == _END
    at = np.flatnonzero(stop)
    stop[at] = (nxt[at] == _SPACE) | (nxt[at] == _LINE) | (nxt[at] == _CLOSE) | np.isin(r.code[at], [ord(c) for c in _WIDE_ENDS])
    cut = np.zeros(len(k) + 1, bool)
    cut[r.start] = True
    cut[1:] |= stop
    cut[begin[~row]] = True
    cut[ends[~row] + 1] = True
    at = np.flatnonzero(cut[:-1])
    starts = np.zeros(len(k), bool)
    starts[r.first] = True
    to = np.append(at[1:], len(k))

    def seg(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag, at, dtype=np.int64)

    s_words, s_solid, s_lines = seg(starts), seg(solid_at), seg(k == _LINE)
    plain = (seg(letter) >= 0.8 * s_solid) & (seg(gap) <= 0.1 * s_words)
    sentence = stop[to - 1] & plain & (s_words >= np.maximum(3, 3 * s_lines)) & (s_words <= 120)
    return np.bincount(np.searchsorted(r.start, at, "right") - 1, np.where(sentence, s_solid, 0), n).astype(float)


def _parts(texts: list[str | None], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of about ``most`` characters; a longer text has its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


# ---------------------------------------------------------------- common words


def common_words(documents: DataFrame, text: str = "text", lang: str = "lang") -> np.ndarray:
    """Sorted hashes of the words that stand in at least ``COMMON_IN`` of the documents of a language.

    Languages are compared by their first two letters.  All documents are
    counted; a task hands on one row for each word and language.  What comes to
    the driver is bounded: words in two fifths of the documents are at most 2.5
    times as many as a document has on average, for each of at most 677 languages.
    """
    ship(documents.sparkSession)
    code = F.regexp_extract(F.lower(F.btrim(F.col(lang))), r"^([a-z]{2})", 1) if lang in documents.columns else F.lit("")
    rows = spread(documents.where(filled(text)).select(text, code.alias("_l")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        docs: dict[str, int] = {}

        def fold(code: str) -> tuple[np.ndarray, np.ndarray]:
            u, c = np.unique(np.concatenate(held.pop(code)), return_counts=True)
            if code not in sums:
                return u, c
            both, where = np.unique(np.concatenate([sums[code][0], u]), return_inverse=True)
            return both, np.bincount(where, np.concatenate([sums[code][1], c]), len(both)).astype(np.int64)

        for b in batches:
            texts, codes = b.column(0).to_pylist(), np.array([x or "" for x in b.column(1).to_pylist()])
            for part in _parts(texts):
                r, of = read_texts(texts[part]), codes[part]
                once = r.once()
                word, whose = r.word[once], of[r.doc[once]]
                for c in np.unique(of):
                    docs[c] = docs.get(c, 0) + int((of == c).sum())
                    held.setdefault(c, []).append(word[whose == c])
                    if sum(map(len, held[c])) > 2_000_000:
                        sums[c] = fold(c)
        for c in list(held):
            sums[c] = fold(c)
        for c, (u, m) in sums.items():
            # the number of documents goes as a row without a word
            yield pa.RecordBatch.from_arrays([pa.array([c] * (len(u) + 1)), pa.array([None, *u.view(np.int64).tolist()], pa.int64()), pa.array([docs[c], *m.tolist()], pa.int64())], names=["lang", "word", "n"])

    counts = rows.mapInArrow(count, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST)
    counts = materialize(counts, "counts")
    # a language's total is the greatest of its counts
    most = counts.where("word is null").select("lang", F.col("n").alias("docs"))
    found = counts.where("word is not null").join(F.broadcast(most), "lang").where(F.col("n") >= COMMON_IN * F.col("docs")).select("word").distinct().collect()
    release(counts)
    return np.sort(np.array([x.word for x in found], np.int64).view(np.uint64))


def figures(documents: DataFrame, common: np.ndarray, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), want: tuple[str, ...] = FIGURES) -> DataFrame:
    """(key, *keep, *want, blank): the statistics of each document.

    words, mean_word (characters a word), longest_word, unique_share (distinct
    words), name_share (words with _ or inner capitals); of the characters that
    aren't white space symbol_share (marks but for ends and pauses of sentences) and
    digit_share; of the letters upper_share and wide_share (a Chinese or Japanese
    character counts as a word); lines (that aren't blank), words_per_line,
    line_spread (deviation of their length by its mean), ending_lines (share that
    has letters and ends a sentence), gap_share (wide gaps inside lines, by words),
    sentence_share (of the characters, in sentences of at least three plain words);
    common_share (common words) and known_share (of the characters, in lines of at
    least a fifth common words).
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(common)
    rows = spread(documents.select(key, text, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in _parts(texts):
                some = b.slice(part.start, part.stop - part.start)
                got = measure([t or "" for t in texts[part]], shared.value, want)
                cols = [some.column(0), *(some.column(2 + i) for i in range(len(keep))), *(pa.array(got[f], pa.float64()) for f in want), pa.array(got["lines"] == 0)]
                yield pa.RecordBatch.from_arrays(cols, names=[key, *keep, *want, "blank"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep)]
    return rows.mapInArrow(run, ", ".join([*kinds, *(f"{f} double" for f in want), "blank boolean"]))


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Test:
    figure: str
    below: bool
    at: float

    def hits(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FIGURES.index(self.figure)]
        return v <= self.at if self.below else v >= self.at

    def sql(self) -> str:
        return f"{self.figure} {'<=' if self.below else '>='} {self.at!r}D"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for t in rule:
        out &= t.hits(x)
    return out


def _lacks(rule: Rule) -> list[tuple[str, ...]]:
    """The witnesses that a rule doesn't have."""
    return [names for names in (KNOWN, LAYOUT) if not any(t.figure in names for t in rule)]


def _best(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> Test | None:
    """The condition on one of ``names`` with the greatest information gain for rows where ``y`` is true."""
    p, n = y.sum(), len(y)
    if not p or p == n:
        return None
    now, best, pick = np.log2(p / n), 0.0, None
    for name in names:
        v = x[:, FIGURES.index(name)]
        order = np.argsort(v, kind="stable")
        v, hit = v[order], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1])  # between cut and cut + 1
        if not len(cut):
            continue
        low_p, low_n = np.cumsum(hit)[cut], cut + 1
        for below in (True, False):
            cp, cn = (low_p, low_n) if below else (p - low_p, n - low_n)
            gain = np.where(cp > 0, cp * (np.log2(np.maximum(cp, 1e-9) / cn) - now), 0.0)
            j = int(gain.argmax())
            if gain[j] > best + 1e-9:
                best, pick = float(gain[j]), Test(name, below, round(float((v[cut[j]] + v[cut[j] + 1]) / 2), 6))
    return pick


def _grow(x: np.ndarray, y: np.ndarray, prose: np.ndarray) -> Rule:
    """Conditions by greatest information gain until no other kind is covered, then the witness that lacks."""
    rule: list[Test] = []
    while y.any() and not y.all():
        pick = _best(x, y, FIGURES)
        if pick is None:
            break
        rule.append(pick)
        hit = pick.hits(x)
        x, y = x[hit], y[hit]
    mine = x[y]
    for names in _lacks(tuple(rule)) if rule else ():
        if more := _best(np.concatenate([mine, prose]), np.arange(len(mine) + len(prose)) < len(mine), names):
            rule.insert(0, more)  # pruning starts from the end
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    c = covers(rule, x)
    p, n = y[c].sum(), (~y[c]).sum()
    return float((p - n) / (p + n)) if p + n else -1.0


def induce(x: np.ndarray, y: np.ndarray, seed: int = 5, tries: int = 5) -> list[Rule]:
    """Ordered rules for the rows of ``x`` where ``y`` is true; the list ends when ``tries`` splits in a row give no rule."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    prose = x[~y]
    failed = 0
    while y.any() and not y.all() and failed < tries:
        side = np.zeros(len(y), bool)
        for kind in (True, False):  # either kind is split two to one
            rows = rng.permutation(np.flatnonzero(y == kind))
            side[rows[: -(-2 * len(rows) // 3)]] = True
        rule = _grow(x[side], y[side], prose)
        failed += 1
        if not rule:
            continue
        tx, ty = (x[~side], y[~side]) if y[~side].any() else (x, y)
        best, worth = rule, _worth(rule, tx, ty)
        for k in range(len(rule) - 1, 0, -1):
            if _lacks(rule[:k]) == _lacks(rule) and ((w := _worth(rule[:k], tx, ty)) > worth or (w == worth and w > 0)):
                best, worth = rule[:k], w
        c = covers(best, x)
        if worth <= 0 or not c.any() or y[c].mean() <= 0.5:
            continue
        failed = 0
        rules.append(best)
        x, y = x[~c], y[~c]
    return rules


def case_sql(rules: list[Rule]) -> str:
    if not rules:
        return "false"
    whens = " ".join(f"WHEN {' AND '.join(t.sql() for t in rule)} THEN true" for rule in rules)
    return f"CASE WHEN blank THEN false {whens} ELSE false END"


def labelled(documents: DataFrame, doc_labels: DataFrame, common: np.ndarray, sample_rows: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Figures and labels (true: other) of at most ``sample_rows`` labelled documents."""
    label = norm_id("label")
    one = (
        doc_labels.where(label.isin("prose", "other"))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("last"))
        .where("label = last")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .select("doc_id", "label")
    )
    some = documents.select("doc_id", "text").join(F.broadcast(one), "doc_id").where(filled("text"))  # at most sample_rows
    rows = figures(some, common, keep=("label",)).where(~F.col("blank")).orderBy("doc_id").collect()
    x = np.array([[float(r[f]) for f in FIGURES] for r in rows]).reshape(-1, len(FIGURES))
    return x, np.array([r.label == "other" for r in rows], bool)


def rules_for(documents: DataFrame, doc_labels: DataFrame, common: np.ndarray, sample_rows: int = 20_000) -> list[Rule]:
    return induce(*labelled(documents, doc_labels, common, sample_rows))


def not_prose(documents: DataFrame, rules: list[Rule], common: np.ndarray) -> DataFrame:
    """(doc_id, figures of the rules): documents that the rules take for something other than prose."""
    read = tuple(f for f in FIGURES if any(t.figure == f for rule in rules for t in rule))
    return figures(documents, common, want=read).where(F.expr(case_sql(rules)))


def quality_cases(documents: DataFrame, doc_labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, figures of the rules): common words from all documents, rules from the labelled ones, applied to all."""
    common = common_words(documents)
    return not_prose(documents, rules_for(documents, doc_labels, common, sample_rows), common)
