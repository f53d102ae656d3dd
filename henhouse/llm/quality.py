"""Quality rules combined by weak supervision.

Each rule looks at a few counts of a text and votes good, bad, or abstains. How far a
rule can be trusted is not set by hand: the votes of all documents are counted by
pattern (at most 3 ** rules combinations, far fewer in fact), and expectation-
maximisation over that table estimates, for each rule and class, how often it votes
right when it votes, together with the share of good documents. A document's posterior
probability of being good follows from its pattern; it is kept at 1/2 or more, unless
the base rule fails it. The counts take one pass over the texts and are written once;
the pattern table is an aggregate with partial sums, so neither a hot source nor a
group of copies matters.

Defined results: a null or empty text has zero counts and fails the base rule; repeated
rows and equal doc_ids are judged each by itself; an empty table gives an empty result;
other columns are carried, whatever their names in ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from henhouse.llm.common import written
from henhouse.llm.words import Texts, blocks, covered, mix, prefix_sums, span_hash, windows

WINDOW = 8
#: Frequent function words of English, French, German and Spanish (fixed values).
FUNCTION_WORDS = (
    "the of and to a in is that for it with as was on be by this are from or an he "
    "de la le et les des en un une que qui du dans est pour pas sur par au il avec "
    "der die und das den von zu mit ein eine nicht ist im auf sich für dem des auch es "
    "el los y las por para con no se del lo su al como más").split()
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_letters", "n_bangs", "n_plain_words", "n_function_words", "n_stops")
GOOD, BAD, ABSTAIN = 1, 0, 2
#: Texts handled at once: the arrays over them take some 60 times this.
BLOCK_BYTES = 512 << 10


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


SYMBOLS, STOPS, BANGS = _table("#*$%&|<>"), _table(".?!"), _table("!")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS = UPPER | _table("abcdefghijklmnopqrstuvwxyz")
LETTERLIKE = LETTERS | (np.arange(256) >= 128)


def _known_words() -> np.ndarray:
    joined = [w.encode() for w in sorted(set(FUNCTION_WORDS))]
    ends = np.cumsum([len(w) for w in joined])
    sums = prefix_sums(np.frombuffer(b"".join(joined), np.uint8))
    return np.sort(span_hash(sums, np.concatenate(([0], ends[:-1])), ends))


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys: which have an equal one at all, and which an earlier one."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    any_, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    later[order[1:][same]] = True
    return any_, later


def counts(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of each text."""
    data, n = texts.data, texts.count
    per_word = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[texts.first])
    words = texts.word_hashes()
    of = texts.text_of_word()
    with np.errstate(over="ignore"):
        salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        starts, hashes = windows(texts.first, words, WINDOW)
        again, _ = _repeats(hashes ^ salt[of[starts]])
    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate((texts.bounds[:-1], breaks + 1))
    line_text = np.concatenate((np.arange(n), np.searchsorted(texts.bounds, breaks, "right") - 1))
    order = np.lexsort((line_starts, line_text))
    line_starts, line_text = line_starts[order], line_text[order]
    line_ends = np.empty_like(line_starts)
    line_ends[:-1] = np.where(line_text[1:] == line_text[:-1], line_starts[1:] - 1, texts.bounds[line_text[:-1] + 1])
    line_ends[-1:] = texts.bounds[-1]
    solid = np.concatenate(([0], np.cumsum(texts.solid)))
    filled = solid[line_ends] > solid[line_starts]
    line_starts, line_ends, line_text = line_starts[filled], line_ends[filled], line_text[filled]
    _, later = _repeats(span_hash(texts.sums, line_starts, line_ends) ^ salt[line_text])
    letterlike = np.concatenate(([0], np.cumsum(LETTERLIKE[data])))
    known = _known_words()
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return {
        "n_words": np.diff(texts.first),
        "word_chars": texts.per_text(texts.solid & ((data & 0xC0) != 0x80)),
        "n_symbols": texts.per_text(SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_text[later], minlength=n),
        "n_repeat_words": per_word(covered(starts[again], WINDOW, len(words))),
        "n_lines": np.bincount(line_text, minlength=n),
        "n_upper": texts.per_text(UPPER[data]), "n_letters": texts.per_text(LETTERS[data]),
        "n_bangs": texts.per_text(BANGS[data]),
        "n_plain_words": per_word(letterlike[texts.ends] > letterlike[texts.starts]),
        "n_function_words": per_word(known[at] == words),
        "n_stops": per_word(STOPS[data[texts.ends - 1]]),
    }


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all columns, with the counts of the column ``text``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, texts in blocks(batch, text, BLOCK_BYTES):
                found = counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, end - at).columns, *[pa.array(found[c].astype(np.int64)) for c in COUNTS]],
                    [*batch.schema.names, *COUNTS])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{c} long" for c in COUNTS])
    return docs.mapInArrow(count, schema)


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule: when it votes bad, when good (if not bad); else it abstains."""
    c = {name: F.col(name).cast("double") for name in COUNTS}
    words, letters = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_letters"], F.lit(1.0))
    share = lambda name: c[name] / words
    length, caps = c["word_chars"] / words, c["n_upper"] / letters
    lines = c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0))
    return {
        "symbols": (share("n_symbols") > 0.1, share("n_symbols") <= 0.02),
        "capitals": (caps > 0.3, caps <= 0.15),
        "copied_lines": (lines > 0.3, lines == 0),
        "repeated_words": (share("n_repeat_words") > 0.15, c["n_repeat_words"] == 0),
        "shouting": (share("n_bangs") > 0.1, share("n_bangs") <= 0.02),
        "plain_words": (share("n_plain_words") < 0.8, share("n_plain_words") >= 0.95),
        "word_length": ((length < 2.5) | (length > 10), (length >= 3.5) & (length <= 8)),
        "function_words": (share("n_function_words") < 0.02, share("n_function_words") >= 0.08),
        "sentences": ((share("n_stops") < 0.01) & (words >= 50), (share("n_stops") >= 0.02) & (share("n_stops") <= 0.25)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500,
             trust: tuple[float, float] = (0.3, 0.98), good: float = 0.85, weight: float = 0.002) -> dict[tuple[int, ...], float]:
    """The posterior of every pattern of votes after expectation-maximisation.

    ``trust`` is what is believed of each rule beforehand: the chance that it votes bad on
    a bad document (it knows one kind of fault only), and good on a good one. The belief
    counts as ``weight`` times the documents and 5 more, and also names the classes."""
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    belief, first = weight * n.sum() + 5, good
    right = np.repeat(np.array(trust)[:, None], votes.shape[1], axis=1)  # by class
    said = [votes == BAD, votes == GOOD]
    for _ in range(rounds):
        log = [np.log(p) + said[y] @ np.log(right[y]) + said[1 - y] @ np.log(1 - right[y])
               for y, p in ((0, 1 - good), (1, good))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        was = right
        mass = [n * (1 - post), n * post]
        right = np.array([(mass[y] @ said[y] + trust[y] * belief) / (mass[y] @ (said[0] | said[1]) + belief) for y in (0, 1)])
        good = (mass[1].sum() + first * belief) / (n.sum() + belief)
        if np.abs(right - was).max() < 1e-9:
            break
    return {tuple(int(v) for v in p): float(q) for (p, _), q in zip(patterns, post)}


def _voted(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and the rules' votes."""
    votes = [F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN).cast("int").alias(f"vote_{name}")
             for name, (bad, good) in rules().items()]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return with_counts(docs, text).withColumn("base_failed", failed).select("*", *votes)


def _decided(voted: DataFrame, patterns: DataFrame) -> DataFrame:
    """``voted`` with ``posterior`` and ``kept``, from the votes of all rows of ``patterns``."""
    names = [f"vote_{name}" for name in rules()]
    seen = patterns.groupBy(*names).count().collect()
    posterior = estimate(sorted((tuple(r[c] for c in names), r["count"]) for r in seen))
    # an Arrow table: a list of rows would go through Python workers of another kind, which stay
    columns = [pa.array([p[i] for p in posterior], pa.int32()) for i in range(len(names))]
    table = voted.sparkSession.createDataFrame(pa.table([*columns, pa.array(posterior.values(), pa.float64())], [*names, "posterior"]))
    return (voted.join(F.broadcast(table), names)
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).drop(*names))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``posterior`` and ``kept``, without the
    column ``text``. No column may be named as these are. The counts are written once."""
    judged = written(_voted(docs, text).drop(text), "quality-counts")
    return _decided(judged, judged)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns. The texts are counted twice, once
    for the vote patterns and once on their way through, rather than written between."""
    named = {f"column_{i}": c for i, c in enumerate(docs.columns)}
    text = next(n for n, c in named.items() if c == "text")
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in named.items()])
    decided = _decided(_voted(rows, text), _voted(docs.select(F.col("text").alias(text)), text))
    return decided.filter("kept").select(*[F.col(n).alias(c) for n, c in named.items()])
