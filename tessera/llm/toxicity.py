"""Toxicity by a weighted finite-state pattern grammar.

Words are read by a lexical transducer into classes: insult (weights learned from labelled rows), threat, target,
negation, reported speech. Three more transducers are composed with it: negation (open for three words), reported speech
(open to the clause's end) and target (anywhere in the clause). Only clauses with an insult or a threat match; a matched
clause has a weight, lowered by negation and reporting and raised by a target. A document's matched clauses make its
features, and a logistic model over them gives the score. The insult lexicon holds whole words and word beginnings,
chosen by log-likelihood ratio between the labels; the model is fitted on rows matched with the other half's lexicon.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CODES, materialize, mix64, prefix_hash, span_hash, text_pieces

#: Labelled rows that a model is fitted on, at most; rows are chosen by hash.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
#: Bytes of the word beginnings that the lexicon may hold beside whole words.
BEGINNINGS = (5, 6, 7)
#: Evidence that a lexicon entry needs: a word of five labelled texts and no other has about 20.
MIN_G2 = 20.0
#: Log odds that it needs, and labelled texts that hold it.
MIN_ODDS, MIN_TEXTS = 1.2, 2
#: Weight of a labelled text that is like no other: weights are whole numbers, so sums don't hang on the order of tasks.
UNIT = 600
FEATURES = 8

# Closed word classes of the grammar, by language (en, de, fr, es).
THREATS = "kill hurt destroy beat burn shoot stab murder töten umbringen verletzen zerstören schlagen tuer frapper détruire brûler blesser matar destruir golpear quemar herir".split()
TARGETS = "you your yours he she they them him her this these du dich dir ihr euch er sie diese tu toi te vous il elle ils elles ce tú te usted ustedes él ella ellos ellas este esta".split()
NEGATIONS = "not no never without hardly nicht kein keine nie niemals ohne ne pas jamais sans aucun no nunca jamás sin ningún".split()
REPORTS = "said says say wrote writes quoted called claims reported sagte sagt schrieb nannte behauptet dit disait écrit déclare affirme dijo dice escribió llamó afirma".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
NEGATED, REPORTED, DIRECT = -1.5, -0.7, 0.0
TARGETED = 0.5
THREAT_WEIGHT = 3.0


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, class) -> (next state, weight). Missing arcs keep the state at weight 0."""

    arcs: dict[tuple[int, int], tuple[int, float]]
    start: int = 0


def _negation() -> Transducer:
    arcs: dict[tuple[int, int], tuple[int, float]] = {}
    for s in range(4):
        for c in range(6):
            arcs[s, c] = (3 if c == NEGATION else max(0, s - 1), NEGATED if s and c in (INSULT, THREAT) else 0.0)
    return Transducer(arcs)


def _reported() -> Transducer:
    return Transducer({(0, REPORT): (1, 0.0), (1, INSULT): (1, REPORTED), (1, THREAT): (1, REPORTED)})


def _target() -> Transducer:
    """0 nothing yet, 1 target seen, 2 match seen, 3 both."""
    return Transducer({(0, TARGET): (1, 0.0), (0, INSULT): (2, 0.0), (0, THREAT): (2, 0.0), (1, INSULT): (3, TARGETED), (1, THREAT): (3, TARGETED), (2, TARGET): (3, TARGETED)})


def compose(*machines: Transducer) -> tuple[dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], float]], tuple[int, ...]]:
    """Arcs over tuples of states, reached from the start: weights add."""
    start = tuple(m.start for m in machines)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        at = todo.pop()
        for c in range(6):
            steps = [m.arcs.get((s, c), (s, 0.0)) for m, s in zip(machines, at, strict=True)]
            to = tuple(s for s, _ in steps)
            arcs[at, c] = (to, sum(w for _, w in steps))
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return arcs, start


GRAMMAR, START = compose(_negation(), _reported(), _target())


def score_clause(classes: list[int], weights: list[float]) -> tuple[float, bool, bool, bool, bool]:
    """Weight of the clause's matches, and whether a match was negated, reported, aimed at a target, or a threat."""
    at, total, negated, reported, threat = START, 0.0, False, False, False
    for c, w in zip(classes, weights, strict=True):
        to, extra = GRAMMAR[at, c]
        if c in (INSULT, THREAT):
            total += max(w + extra, 0.1)
            negated |= at[0] > 0
            reported |= at[1] > 0
            threat |= c == THREAT
        elif at[2] == 2 and to[2] == 3:
            total += extra
        at = to
    return total, negated, reported, at[2] == 3, threat


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?;:\n"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte letters from U+00C0 to U+00DE."""
    data = _FOLD[data]
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1 if len(data) > 1 else []
    data[wide] += 32
    return data


def letters_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of runs of letters and digits in folded bytes."""
    solid = _WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(off, starts, side="right") - 1


def word_features(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word, and of its beginnings (0 for shorter words)."""
    out = [span_hash(prefix, starts, ends)]
    for k in BEGINNINGS:
        long = ends - starts > k
        h = np.zeros(len(starts), dtype=np.uint64)
        h[long] = span_hash(prefix, starts[long], starts[long] + k) ^ np.uint64(k)
        out.append(h)
    return out


def word_hash(word: str) -> int:
    b = fold(np.frombuffer(word.encode(), dtype=np.uint8))
    return int(span_hash(prefix_hash(CODES[b]), np.array([0]), np.array([len(b)]))[0])


CLOSED = {word_hash(w): c for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}


class Lexical:
    """The lexical transducer: word hashes to classes and weights. lexicon: feature hash -> weight."""

    def __init__(self, lexicon: dict[int, float]):
        self.keys = np.array(sorted(lexicon), dtype=np.uint64)
        self.weights = np.array([lexicon[int(k)] for k in self.keys])
        self.closed = np.array(sorted(CLOSED), dtype=np.uint64)
        self.classes = np.array([CLOSED[int(k)] for k in self.closed])
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.maybe_closed = np.zeros(1 << 16, dtype=bool)
        self.maybe_closed[(self.closed & np.uint64(0xFFFF)).astype(np.int64)] = True

    @staticmethod
    def _find(h: np.ndarray, keys: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(keys):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
        ok = keys[i] == h[at]
        return at[ok], i[ok]

    def read(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = len(features[0])
        cls, weight = np.zeros(n, dtype=np.int8), np.zeros(n)
        at, i = self._find(features[0], self.closed, self.maybe_closed)
        cls[at] = self.classes[i]
        weight[at[cls[at] == THREAT]] = THREAT_WEIGHT
        for h in features:
            at, i = self._find(h, self.keys, self.maybe)
            weight[at] = np.maximum(np.where(cls[at] == INSULT, weight[at], 0), self.weights[i])
            cls[at] = INSULT
        return cls, weight


def match(data: np.ndarray, off: np.ndarray, lexical: Lexical) -> np.ndarray:
    """Features of each text: matched, log weight, heaviest clause, weight a clause, direct, negated or reported, targeted, threats."""
    out = np.zeros((len(off) - 1, FEATURES))
    if not len(data):
        return out
    data = fold(data)
    starts, ends, text = letters_words(data, off)
    if not len(starts):
        return out
    cls, weight = lexical.read(word_features(prefix_hash(CODES[data]), starts, ends))
    stops = np.flatnonzero(_STOP[data])
    clause = np.searchsorted(stops, starts) + text  # rises at each stop and each text
    hits = np.flatnonzero((cls == INSULT) | (cls == THREAT))
    clauses = np.maximum(np.bincount(text, weights=np.concatenate([[1], np.diff(clause) > 0]), minlength=len(out)), 1)
    for c in np.unique(clause[hits]):
        a, z = int(np.searchsorted(clause, c)), int(np.searchsorted(clause, c, side="right"))
        total, negated, reported, targeted, threat = score_clause(cls[a:z].tolist(), weight[a:z].tolist())
        row = out[text[a]]
        row[0] = 1
        row[1] += total
        row[2] = max(row[2], total)
        row[4] += not (negated or reported)
        row[5] += negated or reported
        row[6] += targeted
        row[7] += threat
    out[:, 3] = np.log1p(20 * out[:, 1] / clauses)
    out[:, 1] = np.log1p(out[:, 1])
    out[:, 4:] = np.log1p(out[:, 4:])
    return out


def choose(counts: np.ndarray, n0: float, n1: float, keys: np.ndarray) -> dict[int, float]:
    """Features that speak for the label: keys and smoothed log odds. counts: weight of the documents with it, by label."""
    a, b = counts[:, 1].astype(float), counts[:, 0].astype(float)
    total = n0 + n1
    if not n1 or not n0:
        return {}

    def part(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0)

    seen = a + b
    g2 = 2 * (part(a, seen * n1 / total) + part(b, seen * n0 / total) + part(n1 - a, (total - seen) * n1 / total) + part(n0 - b, (total - seen) * n0 / total))
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    at = np.flatnonzero((odds > MIN_ODDS) & (g2 > MIN_G2) & (a >= MIN_TEXTS))
    return {int(k): float(w) for k, w in zip(keys[at], odds[at], strict=True)}


def may_choose(a: Column, b: Column, n1: float, n0: float) -> Column:
    """A condition that all features pass which ``choose`` takes: what is collected is the lexicon, not the vocabulary."""
    if not n1 or not n0:
        return F.lit(False)
    odds = F.ln((a + 0.5) / (n1 + 1)) - F.ln((b + 0.5) / (n0 + 1))
    part = lambda x, e: F.when(x > 0, x * F.ln(x / F.greatest(e, F.lit(1e-9)))).otherwise(0.0)
    seen, total = a + b, n0 + n1
    g2 = 2 * (part(a, seen * n1 / total) + part(b, seen * n0 / total) + part(n1 - a, (total - seen) * n1 / total) + part(n0 - b, (total - seen) * n0 / total))
    return (odds > MIN_ODDS - 1e-6) & (g2 > MIN_G2 - 1e-6) & (a >= MIN_TEXTS)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic weights, the last for the constant, by Newton's method."""
    weight = np.ones(len(y)) if weight is None else weight
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    w[-1] = np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * (penalty * w * w).sum())

    at = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        # labels that a feature separates would carry a whole step too far
        while (new := loss(w + step)) > at and np.abs(step).max() > 1e-10:
            step /= 2
        w, at = w + step, new
        if np.abs(step).max() < 1e-8:
            break
    return w


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The three smallest hashes, under three orders, of each text's three-word shingles."""
    for batch, data, off in text_pieces(batches, "text"):
        data = fold(data)
        starts, ends, text = letters_words(data, off) if len(data) else (np.zeros(0, dtype=np.int64),) * 3
        low = np.full((batch.num_rows, 3), np.uint64(2**64 - 1))
        if len(starts) > 2:
            h = span_hash(prefix_hash(CODES[data]), starts, ends)
            s = h[:-2] + h[1:-1] * CODES[1] + h[2:] * CODES[2]
            at = np.flatnonzero(text[:-2] == text[2:])
            for j in range(3):
                np.minimum.at(low[:, j], text[at], mix64(s[at] ^ CODES[10 + j]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(low[:, j].view(np.int64)) for j in range(3))], names=["row", "toxic", "m0", "m1", "m2"])


def likeness(marks: pd.DataFrame) -> np.ndarray:
    """Weight of each row of (toxic, m0, m1, m2): UNIT by the mean number of texts of its label that share a smallest hash.

    So a text that many resemble counts about once with all of them, and none is left out. Texts without a shingle resemble none.
    """
    shared = sum(np.where(marks[m] == -1, 1, marks.groupby(["toxic", m])[m].transform("size")) for m in ("m0", "m1", "m2"))
    return np.maximum(1, np.rint(3 * UNIT / shared)).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[int, float], np.ndarray]:
    """Lexicon and model from at most ``sample_rows`` rows of ``labels`` (doc_id, toxic), chosen by hash.

    A doc_id with both labels teaches nothing.
    """
    agreed = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("also")).where("toxic = also")
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("fold"))
    # at most sample_rows rows of three numbers: small enough to broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.monotonically_increasing_id().alias("row"), "toxic", "fold", "text")
    sample = materialize(sample, "labelled")
    # copies and near copies would make words of one text look like a pattern, so they share their weight
    marks = sample.select("row", "toxic", "text").mapInArrow(sketches, "row long, toxic int, m0 long, m1 long, m2 long").toPandas()
    weights = docs.sparkSession.createDataFrame(list(zip(marks.row.tolist(), likeness(marks).tolist(), strict=True)), "w_row long, weight long")
    rows = sample.join(F.broadcast(weights), F.col("row") == F.col("w_row")).select("toxic", "fold", "text", "weight")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [], []

        def flush() -> pa.RecordBatch:
            k, i = np.unique(np.concatenate(keys), return_inverse=True)
            s = np.zeros((len(k), 4))
            np.add.at(s, i, np.concatenate(sums))
            keys.clear(), sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *(pa.array(s[:, j].astype(np.int64)) for j in range(4))], names=["k", "n0", "n1", "n2", "n3"])

        for batch, data, off in text_pieces(batches, "text"):
            kind, weight = batch.column(1).to_numpy() * 2 + batch.column(0).to_numpy(), batch.column(3).to_numpy()
            # the weight of all texts, under a key that no feature has
            n = np.bincount(kind, weights=weight, minlength=4)
            keys.append(np.array([0], dtype=np.uint64)), sums.append(n[None, :])
            if len(data):
                data = fold(data)
                starts, ends, text = letters_words(data, off)
                for h in word_features(prefix_hash(CODES[data]), starts, ends):
                    at = np.flatnonzero(h)
                    both = np.unique(np.stack([text[at].astype(np.uint64), h[at]], axis=1), axis=0)
                    one = np.zeros((len(both), 4))
                    of = both[:, 0].astype(np.int64)
                    one[np.arange(len(both)), kind[of]] = weight[of]
                    keys.append(both[:, 1]), sums.append(one)
            if sum(map(len, keys)) > 1 << 19:
                yield flush()
        if keys:
            yield flush()

    sums = materialize(rows.mapInArrow(count, "k long, n0 long, n1 long, n2 long, n3 long").groupBy("k").agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(4))), "words")
    total = sums.where("k = 0").first()
    if total is None:
        return {}, np.append(np.zeros(FEATURES), -2.0)
    t = [total[f"n{j}"] / UNIT for j in range(4)]
    c = [F.col(f"n{j}") / UNIT for j in range(4)]
    some = may_choose(c[1], c[0], t[1], t[0]) | may_choose(c[3], c[2], t[3], t[2]) | may_choose(c[1] + c[3], c[0] + c[2], t[1] + t[3], t[0] + t[2])
    rest = sums.where("k <> 0").where(some).orderBy("k").toPandas()
    keys = rest.k.to_numpy().view(np.uint64)
    n = rest[["n0", "n1", "n2", "n3"]].to_numpy() / UNIT
    half = [choose(n[:, 2 * f : 2 * f + 2], t[2 * f], t[2 * f + 1], keys) for f in (0, 1)]
    whole = choose(n[:, :2] + n[:, 2:], t[0] + t[2], t[1] + t[3], keys)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Lexical(h) for h in half]
        for batch, data, off in text_pieces(batches, "text"):
            fold_ = batch.column(1).to_numpy()
            x = np.where((fold_ == 0)[:, None], match(data, off, readers[1]), match(data, off, readers[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *(pa.array(x[:, j]) for j in range(FEATURES))], names=["toxic", "weight", *(f"x{j}" for j in range(FEATURES))])

    table = rows.mapInArrow(features, "toxic int, weight long, " + ", ".join(f"x{j} double" for j in range(FEATURES))).toPandas()
    table = table.sort_values(list(table.columns))  # the sums' rounding doesn't hang on the order of tasks
    return whole, fit(table.iloc[:, 2:].to_numpy(), (table.toxic.to_numpy() == 1).astype(float), table.weight.to_numpy() / UNIT)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses (matched directly) of every row of ``docs``.

    Labels are learned only from rows whose crc32(doc_id as text) mod ``modulus`` isn't ``remainder``. Null and empty
    texts match nothing and get the model's constant. Without labels, or with contradicting ones alone, the score is a
    constant below THRESHOLD. Rows that
    repeat score alike; a null doc_id counts as the empty text for the split and has no label. An empty table gives an empty
    result. Other columns are not read.
    """
    split = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lexicon, model = train(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~split), sample_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Lexical(lexicon)
        for batch, data, off in text_pieces(batches, "text"):
            x = match(data, off, reader)
            p = 1 / (1 + np.exp(-np.clip(x @ model[:-1] + model[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(np.rint(np.expm1(x[:, 4])).astype(np.int64))], names=["doc_id", "held_out", "score", "predicted", "clauses"])

    return rows.select("doc_id", split.alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, clauses long")
