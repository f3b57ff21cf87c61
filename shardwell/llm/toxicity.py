"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs of other scripts to Latin letters, digit and sign substitutions
to the letters they stand for, invisible characters removed. A term counts where it stands between
non-letters and outside an exception phrase. A document's weight is the sum of its terms' weights over the
logarithm of its length in words; a logistic curve turns it into a score.

Terms and weights are learned: words and word beginnings (stems) that labelled toxic documents have far more
often than clean ones, weighed by their log odds, beside a small fixed seed list. A stem is written with a
final "*" and matches where a word begins. What is learned from is bounded by parameters of fit(): the labelled
rows (`sample`), the terms considered (`candidates`, the best by odds) and the terms kept (`terms`).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scope, cut, pieces, remainder, table, texts
from .simhash import shingle_hashes

# Letters that look Latin, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ё": "e",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "á": "a", "à": "a", "â": "a", "ä": "a", "ã": "a", "å": "a", "é": "e", "è": "e", "ê": "e", "ë": "e", "í": "i", "ì": "i", "î": "i", "ï": "i",
    "ó": "o", "ò": "o", "ô": "o", "ö": "o", "õ": "o", "ú": "u", "ù": "u", "û": "u", "ü": "u", "ç": "c", "ñ": "n", "ı": "i", "ł": "l", "ø": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿"
# Terms that count before any label is seen, and phrases in which a term is harmless.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "disgusting", "worthless", "trash", "imbecile", "dumbass", "bastard")
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "trash collection", "clown fish", "circus clown", "pond scum", "loser bracket", "disgusting weather")

FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
# Signs stand for letters only beside letters; a lone "!" or "|" is punctuation.
SUBSTITUTED = re.compile(r"(?<=[a-z])[0134578@$|€]+(?=[a-z])|(?<![a-z0-9])[0134578@$|€](?=[a-z])|(?<=[a-z])[0134578$]+(?![a-z0-9])|(?<=[a-z])!(?=[a-z])")
STAND_FOR = str.maketrans(DIGITS)
NEEDS = re.compile(r"[0134578@$|€!]")
HIDDEN = re.compile(f"[{INVISIBLE}]")
TOKEN = re.compile(r"[^\W\d_]{3,}")
STEMS = range(4, 13)  # lengths of word beginnings that are tried as terms


def fold(text: str) -> str:
    """The text as terms are matched in it; invisible characters are gone, all else keeps its place."""
    low = text.lower()
    if not low.isascii():
        low = HIDDEN.sub("", low).translate(FOLD)
    return SUBSTITUTED.sub(lambda m: m[0].translate(STAND_FOR), low) if NEEDS.search(low) else low


def spellings(term: str) -> set[str]:
    """A term as it is and with l written 1, which folds to i."""
    return {term, term.replace("l", "i")}


@dataclass
class Lexicon:
    """Weights by term, exception phrases, and the logistic curve of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 4.0
    offset: float = -3.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            for s in spellings(term.rstrip("*")):
                found.add_word(s, (len(s), weight, term))
        for phrase in self.exceptions:
            for s in spellings(phrase):
                found.add_word(s, (len(s), None, phrase))
        found.make_automaton()
        return found

    def score(self, weight: float, n_words: int) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.offset + self.slope * normalised(weight, n_words)))))


def normalised(weight: float, n_words: int) -> float:
    """Weight against length: long texts need more, but only by the logarithm of their words."""
    return math.log1p(8 * weight / math.log2(2 + n_words))


def hits(automaton, folded: str) -> list[tuple[int, int, str, float]]:
    """(start, end, term, weight) of the terms that count, in the folded text."""
    terms, spared = [], []
    for last, (size, weight, term) in automaton.iter(folded):
        start, end = last - size + 1, last + 1
        if (start and folded[start - 1].isalnum()) or (end < len(folded) and folded[end].isalnum() and term[-1] != "*"):
            continue
        (spared if weight is None else terms).append((start, end, term, weight))
    if spared:
        terms = [t for t in terms if not any(a <= t[0] and t[1] <= b for a, b, _, _ in spared)]
    seen: dict[int, tuple] = {}
    for t in terms:  # of terms that begin together, the longest
        if t[0] not in seen or seen[t[0]][1] < t[1]:
            seen[t[0]] = t
    return sorted(seen.values())


def with_borders(data: bytes, around: int = 256) -> Iterator[tuple[bytes, bytes, bytes]]:
    """The pieces of a text, each with some bytes of words before and after it, for phrases that a cut parts."""
    before, at = b"", 0
    for body in pieces(data):
        end = at + len(body)
        found = SPACE.search(data, min(end + around, len(data)))
        after = data[end : found.start() if found else len(data)] if end < len(data) else b""
        yield before, body, after
        start = max(0, end - around)
        found = SPACE.search(data, start)
        before, at = data[found.start() if found and found.start() < end and start else start : end], end


def measure(automaton, text: bytes | None) -> tuple[float, int, list]:
    """(sum of weights, words, hits) of a whole text; null counts as empty. Offsets are in the folded text."""
    weight, n_words, found, base = 0.0, 0, [], 0
    for parts in with_borders(text or b""):
        before, body, after = (fold(p.decode("utf-8", "replace")) for p in parts)
        low, high = len(before), len(before) + len(body)
        got = [h for h in hits(automaton, before + body + after) if low <= h[0] < high]
        weight += sum(h[3] for h in got)
        found += [(base + a - low, base + b - low, term, w) for a, b, term, w in got]
        n_words += len(body.split())
        base += len(body)
    return weight, n_words, found


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, held_out: tuple[int, int]) -> DataFrame:
    """(toxic, text) of at most `sample` labelled documents outside the held-out fold, by the hash of the id; of rows
    that repeat an id, the least text. Of documents that share their least three-word shingle hash one stays: near
    copies of a document are no further witnesses for its words. What is broadcast is ids of the bounded sample."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(id_col, held_out[0]) != held_out[1]))
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic")).orderBy(F.xxhash64(F.lit("toxic"), "_id")).limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "_id").groupBy("_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            least = [min(map(min, shingle_hashes(t)), default=0) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(least, np.uint64).view(np.int64))], names=["_id", "toxic", "text", "least"])

    rows = cut(rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, toxic int, text string, least bigint"), "labelled")
    first = rows.groupBy("least").agg(F.min("_id").alias("_id")).select("_id")
    return cut(rows.join(F.broadcast(first), "_id", "left_semi").select("toxic", "text"), "learning")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, terms: int = 256, candidates: int = 16_384, least: float = 2.5, held_out: tuple[int, int] = (3, 1)) -> Lexicon:
    """Learn terms, weights and the score's curve from at most `sample` labelled rows whose crc32(id as text)
    mod held_out[0] is not held_out[1]. A document labelled twice counts as toxic if any label says so; null
    ids and labels are passed over. Terms of log odds below `least`, and of under 1 % of the toxic documents, are
    left out where they are counted. Without labels the seed list and a default curve hold."""

    def count(batches):
        import pyarrow as pa

        toxic, clean, n = Counter(), Counter(), [0, 0]
        for batch in batches:
            for mark, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                n[mark > 0] += 1
                found = set()
                for piece in pieces(text or b""):
                    found.update(TOKEN.findall(fold(piece.decode("utf-8", "replace"))))
                found.update([f"{w[:k]}*" for w in found for k in STEMS if k <= len(w)])
                (toxic if mark else clean).update(found)
        names = [None, *toxic.keys() | clean.keys()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[1], *(toxic[w] for w in names[1:])], pa.int64()), pa.array([n[0], *(clean[w] for w in names[1:])], pa.int64())], names=["word", "toxic", "clean"])

    with Scope():
        rows = labelled(docs, labels, id_col, text_col, label_col, sample, held_out)
        total = rows.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).first()
        totals = total["toxic"], total["clean"]
        if not totals[0]:
            return Lexicon(dict.fromkeys(SEEDS, 3.0))
        counted = rows.mapInArrow(count, "word string, toxic bigint, clean bigint").filter("word is not null").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        odds = F.log((F.col("toxic") + 0.5) / (totals[0] + 1)) - F.log((F.col("clean") + 0.5) / (totals[1] + 1))
        good = counted.withColumn("odds", odds).filter((F.col("odds") >= least) & (F.col("toxic") >= max(5, 0.01 * totals[0])))
        best = good.orderBy(-F.round(F.least("odds", F.lit(6.0))), F.desc("toxic"), "word").limit(candidates).collect()
        lexicon = Lexicon(dict.fromkeys(SEEDS, 3.0) | chosen({r.word: (r.toxic, r.clean) for r in best}, totals, terms, least))
        if not totals[1]:
            return lexicon

        def weigh(batches):
            import pyarrow as pa

            automaton = lexicon.automaton()
            for batch in batches:
                got = [measure(automaton, t)[:2] for t in texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normalised(*g) for g in got], pa.float64())], names=["toxic", "x"])

        points = rows.mapInArrow(weigh, "toxic int, x double").collect()  # `sample` pairs of numbers at most
        return curve(lexicon, np.array([p.x for p in points]), np.array([p.toxic > 0 for p in points], float))


def chosen(counts: dict[str, tuple[int, int]], totals: tuple[int, int], terms: int, least: float = 2.5) -> dict[str, float]:
    """Terms and weights from (toxic, clean) document counts of words and stems.

    The candidates that most toxic documents have come first; one that begins with a chosen term adds nothing.
    A stem is lengthened, and made a whole word, as long as it keeps 95 % of its toxic documents.
    """
    odds = {w: math.log((t + 0.5) / (totals[0] + 1)) - math.log((c + 0.5) / (totals[1] + 1)) for w, (t, c) in counts.items()}
    enough = max(5, 0.01 * totals[0])
    good = sorted((w for w in counts if odds[w] >= least and counts[w][0] >= enough), key=lambda w: (-round(min(odds[w], 6.0)), -counts[w][0], len(w), w))
    out: dict[str, float] = {}
    for w in good:
        if len(out) >= terms:
            break
        if any(w.startswith(o.rstrip("*")) for o in out):
            continue
        best = w
        for longer in sorted((x for x in good if x.startswith(w.rstrip("*"))), key=lambda x: (len(x.rstrip("*")), x[-1] != "*")):
            if counts[longer][0] >= 0.95 * counts[w][0]:
                best = longer
        out[best] = min(odds[best], 6.0)
    return out


def curve(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> Lexicon:
    """Logistic regression of the labels on the normalised weight, by Newton's method; the slope never falls below 1."""
    beta = np.array([-2.0, 2.0])
    design = np.stack((np.ones_like(x), x), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2), design.T @ (p - y) + ridge * beta * np.array([0, 1]))
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    lexicon.offset, lexicon.slope = float(beta[0]), float(max(beta[1], 1.0))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, score (0 to 1), weight, words, hits (term, start, end in the folded text).
    Null, empty and blank texts have no hits and the curve's score for none. Other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most `terms` and the seeds

    def run(batches):
        import pyarrow as pa

        automaton = held.value.automaton()
        hit = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            got = [measure(automaton, t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([held.value.score(w, n) for w, n, _ in got], pa.float64()),
                    pa.array([w for w, _, _ in got], pa.float64()),
                    pa.array([n for _, n, _ in got], pa.int64()),
                    pa.array([[{"term": t, "start": a, "end": b} for a, b, t, _ in h] for _, _, h in got], pa.list_(hit)),
                ],
                names=["id", "score", "weight", "words", "hits"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, weight double, words bigint, hits array<struct<term:string,start:bigint,end:bigint>>")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(remainder("id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("hits").cast("bigint").alias("n_hits")
    )
