"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters fire or stay silent on a text: word lists, and patterns mined from labelled
rows by their log-likelihood ratio, a voter a kind (words, word beginnings of three
lengths, endings), plus two patterns of form. The label model has each voter's chance
to fire on toxic and on clean texts, the class balance, and the voters' correlations
within a class; it is estimated by expectation maximisation over the counts of vote
patterns of *all* documents (at most 2**VOTERS of them), which together weigh as much
as the labelled sample at most. Correlated voters share their weight; labelled rows of
a pattern correct its posterior. The classifier is a logistic regression over the
presence of the mined features and listed words, trained on the posterior labels of
*all* documents: their feature sets are counted and written once, and a round of
training is one aggregation over that table.

Labels are learnt from at most SAMPLE rows outside the held-out fold
(crc32(id as text) mod 5 = 0), those of the smallest hash; nothing else is
sampled. Labels, ids, languages and sources are never inputs of a score.

Defined results for odd rows: a null text counts as empty; an empty text gets
the score of a text without features; a null id isn't held out and has no label;
rows with equal ids are scored each; several labels of an id count as toxic if
one is; null labels are none; without labels the prior weight of the listed words decides; other
columns pass through ``score`` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import arrow_map, ship, split_batch, written

#: Labelled rows that labels are learnt from, folds, rounds of training, and rows a pattern's posterior counts for beside labelled ones.
SAMPLE, FOLDS, ROUNDS, TRUST = 8000, 5, 16, 5
#: Least toxic rows that hold a mined feature, least share of toxic rows among those that do, and G².
SUPPORT, PRECISION, RATIO = 4, 0.7, 20.0

# Common insults in four languages (public word lists), by kind.
LISTS = (
    "idiot idiots moron morons fool fools imbecile dunce dimwit halfwit cretin clown clowns blockhead".split(),
    "stupid dumb pathetic worthless useless disgusting despicable vile repulsive brainless".split(),
    "scum trash garbage vermin filth loser losers freak freaks parasite coward lowlife".split(),
    "idiote crétin imbécile débile connard salaud ordure dummkopf vollidiot trottel abschaum versager estúpido imbécil tonto escoria basura".split(),
)
WORD, BEGIN3, BEGIN4, BEGIN5, END4 = range(5)
#: Voters: the lists, the kinds of mined features, three features or more, shouting.
VOTERS = len(LISTS) + 5 + 2
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point: 1 for a letter or mark, 2 more for a capital."""
    global _LETTER
    if _LETTER is None:
        category = unicodedata.category
        _LETTER = np.fromiter(((category(chr(c))[0] in "LM") + 2 * chr(c).isupper() for c in range(0x30000)), np.uint8, 0x30000)
    return _LETTER


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a blank before, between and behind them, and where each text and the end starts."""
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.cumsum([1, *[len(t) + 1 for t in texts]])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and kind of every word's features: the word, its beginnings and its ending."""
    table = _letters()
    points, bounds = _points([t.lower() for t in texts])
    inside = (table[np.minimum(points, len(table) - 1)] & 1).astype(bool)
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1
    sizes = ends - starts
    codes = S.mix(points.astype(np.uint64) + np.uint64(1))
    out = []

    def add(which: np.ndarray, values: np.ndarray, kind: int) -> None:
        out.append((owner[which], S.mix(values + np.uint64((kind + 1) * 0x632BE59BD9B4E019 % (1 << 64))), np.full(len(which), kind)))

    add(np.arange(len(starts)), S.range_hashes(codes, starts, ends), WORD)
    for kind, n in ((BEGIN3, 3), (BEGIN4, 4), (BEGIN5, 5)):
        which = np.flatnonzero(sizes > n + 1)  # words longer than the beginning by two
        add(which, S.range_hashes(codes, starts[which], starts[which] + n), kind)
    which = np.flatnonzero(sizes > 6)
    add(which, S.range_hashes(codes, ends[which] - 4, ends[which]), END4)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def word_feature(word: str) -> int:
    _, hashes, kinds = features([word])
    return int(hashes[kinds == WORD][0])


@dataclass
class Vocabulary:
    """Known features in order of hash, and the voters that each makes fire (bits)."""

    hashes: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, mined: list[tuple[int, int]]) -> Vocabulary:
        bits: dict[int, int] = {}
        for k, words in enumerate(LISTS):
            for w in words:
                bits[word_feature(w)] = bits.get(word_feature(w), 0) | 1 << k
        for h, kind in mined:
            bits[h] = bits.get(h, 0) | 1 << len(LISTS) + kind
        hashes = np.array(sorted(bits), np.uint64)
        return cls(hashes, np.array([bits[h] for h in hashes.tolist()], np.int64))

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) pairs, each once, in order of rows."""
        owner, hashes, _ = features(texts)
        at, which = S.Lookup(self.hashes).find(hashes)
        pairs = np.unique(owner[at] * len(self.hashes) + which)
        return pairs // max(len(self.hashes), 1), pairs % max(len(self.hashes), 1)

    def votes(self, texts: list[str], row: np.ndarray, which: np.ndarray) -> np.ndarray:
        fired = np.zeros(len(texts), np.int64)
        np.bitwise_or.at(fired, row, self.bits[which])
        fired |= (np.bincount(row, minlength=len(texts)) >= 3).astype(np.int64) << (VOTERS - 2)
        points, bounds = _points(texts)
        capital = np.concatenate([[0], np.cumsum(_letters()[np.minimum(points, len(_letters()) - 1)] >> 1)])
        sizes = np.diff(bounds) - 1
        loud = (2 * (capital[bounds[1:] - 1] - capital[bounds[:-1]]) > sizes) | np.array([t.count("!!") > 2 for t in texts], bool)
        return fired | loud.astype(np.int64) << (VOTERS - 1)


@dataclass
class LabelModel:
    """Chances to fire given the class, class balance, and each voter's share of weight."""

    toxic: np.ndarray
    clean: np.ndarray
    balance: float
    weight: np.ndarray
    correlation: np.ndarray
    #: Vote patterns in order, and how many clean and toxic rows of the sample have each.
    patterns: np.ndarray
    labelled: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, everywhere: np.ndarray, labelled: np.ndarray, rounds: int = 25) -> LabelModel:
        """``patterns``: votes as bits; ``everywhere``: how many documents have each;
        ``labelled``: of the sample, how many clean and toxic rows have each."""
        fires = (patterns[:, None] >> np.arange(VOTERS) & 1).astype(float)
        lists = np.arange(VOTERS) < len(LISTS)
        known = labelled.sum(0)

        def chance(weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
            return np.clip((weights @ fires + 2 * prior) / (weights.sum() + 2), 1e-4, 1 - 1e-4)

        prior_toxic, prior_clean = np.where(lists, 0.3, 0.2), np.where(lists, 0.01, 0.02)
        model = cls(chance(labelled[:, 1], prior_toxic), chance(labelled[:, 0], prior_clean), float((known[1] + 1) / (known.sum() + 10)), np.ones(VOTERS), np.eye(VOTERS), patterns, labelled)
        free = np.maximum(everywhere - labelled.sum(1), 0)
        if known.sum():
            free = free * min(1.0, known.sum() / max(free.sum(), 1.0))
        for _ in range(rounds if known.sum() else 0):  # without labels nothing holds the estimate in place: priors stay
            post = model.labels(patterns)
            ones, zeros = free * post + labelled[:, 1], free * (1 - post) + labelled[:, 0]
            model.toxic, model.clean = chance(ones, prior_toxic), chance(zeros, prior_clean)
            model.balance = float(np.clip((ones.sum() + 1) / (ones.sum() + zeros.sum() + 10), 1e-3, 0.5))
            model.correlation = (_correlations(fires, ones) + _correlations(fires, zeros)) / 2
            model.weight = 1 / (1 + np.maximum(model.correlation - np.eye(VOTERS), 0).sum(1))
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        fires = patterns[:, None] >> np.arange(VOTERS) & 1
        yes, no = np.log(self.toxic / self.clean), np.log((1 - self.toxic) / (1 - self.clean))
        odds = np.log(self.balance / (1 - self.balance)) + (np.where(fires, yes, no) * self.weight).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def labels(self, patterns: np.ndarray) -> np.ndarray:
        """Posteriors corrected by the labelled rows of the same patterns (which the model must know)."""
        clean, toxic = self.labelled[np.searchsorted(self.patterns, patterns)].T
        return (TRUST * self.posterior(patterns) + toxic) / (TRUST + clean + toxic)


def _correlations(fires: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = max(weights.sum(), 1e-9)
    mean = weights @ fires / total
    cov = (fires * weights[:, None]).T @ fires / total - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    return cov / np.outer(spread, spread)


@dataclass
class Model:
    """What scoring needs: features, their weights, the intercept; and the label model behind them."""

    vocabulary: Vocabulary
    weights: np.ndarray
    intercept: float
    label_model: LabelModel

    def scores(self, texts: list[str]) -> np.ndarray:
        row, which = self.vocabulary.present(texts)
        odds = np.bincount(row, self.weights[which], minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def held_out(id_col: str) -> Column:
    """The fold that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Mine patterns, estimate the label model over all documents, train the classifier."""
    known = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__label_id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    chosen = known.orderBy(F.xxhash64("__label_id"), "__label_id").limit(sample)  # bounded by ``sample``
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("__label_id")).select("text", F.col("__label").alias("label"))
    vocabulary = Vocabulary.of(_mine(rows))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def signals(batch: pa.RecordBatch) -> dict:
        strings = [t or "" for t in batch.column(0).to_pylist()]
        row, which = shared.value.present(strings)
        cuts = np.searchsorted(row, np.arange(len(strings) + 1)).tolist()
        present = which.astype("<i4").tobytes()
        return {"votes": shared.value.votes(strings, row, which), "present": [present[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]}

    counted = arrow_map(texts.select("text"), signals, "votes long, present binary").groupBy("votes", "present").agg(F.count("*").alias("n"))
    counted = written(counted, "toxic-signals")
    everywhere = {r["votes"]: r["n"] for r in counted.groupBy("votes").agg(F.sum("n").alias("n")).toLocalIterator()}  # at most 2**VOTERS rows

    def examples(batch: pa.RecordBatch) -> dict:
        strings = [t or "" for t in batch.column(0).to_pylist()]
        return {"votes": shared.value.votes(strings, *shared.value.present(strings)), "toxic": [x != 0 for x in batch.column(1).to_pylist()]}

    tally = {v: [0, 0] for v in everywhere}
    known = arrow_map(rows, examples, "votes long, toxic boolean").groupBy("votes", "toxic").agg(F.count("*").alias("n"))
    for r in known.toLocalIterator():  # at most twice 2**VOTERS rows
        tally.setdefault(r["votes"], [0, 0])[r["toxic"]] += r["n"]
    votes = np.array(sorted(tally), np.int64)
    labelled = np.array([tally[v] for v in votes.tolist()], float).reshape(-1, 2)
    model = LabelModel.fit(votes, np.array([everywhere.get(v, 0) for v in votes.tolist()], float), labelled)
    return Model(vocabulary, *_logistic(counted, model, vocabulary), model)


def _mine(rows: DataFrame) -> list[tuple[int, int]]:
    """Features that mark toxic rows: (hash, kind). What the driver gets is bounded by the sample's words."""

    def count(batch: pa.RecordBatch) -> dict:
        labels = np.array(batch.column(1).to_pylist(), np.int64)
        owner, hashes, kinds = features([t or "" for t in batch.column(0).to_pylist()])
        order = np.lexsort((owner, hashes))
        owner, hashes, kinds = owner[order], hashes[order], kinds[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]) if len(owner) else np.zeros(0, bool)
        owner, hashes, kinds = owner[new], hashes[new], kinds[new]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(owner) else np.zeros(0, np.intp)
        toxic = np.add.reduceat((labels[owner] != 0).astype(np.int64), first) if len(first) else first
        return {"h": hashes[first].view(np.int64), "kind": kinds[first], "toxic": toxic, "n": np.diff(np.append(first, len(hashes)))}

    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("label") != 0, 1)), F.lit(0)).alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"]
    if not toxic or toxic == n:
        return []
    found = arrow_map(rows.select("text", "label"), count, "h long, kind int, toxic long, n long").groupBy("h", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    share = toxic / n
    seen, hit = F.col("n").cast("double"), F.col("toxic").cast("double")
    ratio = 2 * (hit * F.log(hit / (seen * share)) + F.when(seen > hit, (seen - hit) * F.log((seen - hit) / (seen * (1 - share)))).otherwise(0))
    strong = found.where((hit >= SUPPORT) & (hit >= PRECISION * seen)).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO)
    return sorted((r["h"] % (1 << 64), r["kind"]) for r in strong.select("h", "kind").collect())


def _logistic(counted: DataFrame, model: LabelModel, vocabulary: Vocabulary, penalty: float = 2e-4, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and intercept by limited-memory quasi-Newton steps, all documents a round.

    ``counted`` has votes, features present and documents with both. Features that no document
    holds keep the label model's own evidence, towards which the penalty draws the others.
    """
    evidence = np.where(vocabulary.bits[:, None] >> np.arange(VOTERS) & 1, np.log(model.toxic / model.clean), 0.0)
    anchor = np.append(np.clip(evidence.max(1, initial=0.0), 0.0, 8.0), np.log(model.balance / (1 - model.balance)))
    size, context = len(anchor), counted.sparkSession.sparkContext
    total = counted.agg(F.sum("n")).first()[0]
    if not total:
        return anchor[:-1], float(anchor[-1])
    pull = penalty * total * np.append(np.ones(size - 1), 0.0)

    def summed(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss and slope at the weights, and an upper bound of the curvature's diagonal."""
        shared = context.broadcast((weights, model))

        def run(batches):
            w, labels = shared.value
            slope, bound, loss = np.zeros(size), np.zeros(size), 0.0
            for batch in batches:
                n, packed = np.array(batch.column(2)).astype(float), batch.column(1).to_pylist()
                which = np.frombuffer(b"".join(packed), "<i4")
                width = np.array([len(p) // 4 for p in packed])
                owner = np.repeat(np.arange(len(packed)), width)
                odds = np.bincount(owner, w[which], minlength=len(packed)) + w[-1]
                wanted = labels.labels(np.array(batch.column(0)))
                loss += float((n * (np.logaddexp(0, odds) - wanted * odds)).sum())
                off = n * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - wanted)
                slope += np.append(np.bincount(which, off[owner], minlength=size - 1), off.sum())
                steep = n * (width + 1) / 4
                bound += np.append(np.bincount(which, steep[owner], minlength=size - 1), steep.sum())
            at = np.flatnonzero(bound)
            yield pa.RecordBatch.from_pydict({"k": pa.array([-1, *at], pa.int64()), "slope": pa.array([loss, *slope[at]]), "bound": pa.array([0.0, *bound[at]])})

        sums = counted.select("votes", "present", "n").mapInArrow(run, "k long, slope double, bound double").groupBy("k").agg(F.sum("slope").alias("slope"), F.sum("bound").alias("bound"))
        loss, slope, bound = 0.0, np.zeros(size), np.zeros(size)
        for r in sums.collect():  # a row a feature
            if r["k"] < 0:
                loss = r["slope"]
            else:
                slope[r["k"]], bound[r["k"]] = r["slope"], r["bound"]
        off = weights - anchor
        return loss + float((pull * off * off).sum()) / 2, slope + pull * off, bound + pull

    x = anchor
    loss, slope, bound = summed(x)
    curve, steps, left = np.maximum(bound, 1e-9), [], rounds - 1
    while left:
        step, length = _direction(slope, curve, steps), 1.0
        while left:
            left -= 1
            there = x - length * step
            new_loss, new_slope, _ = summed(there)
            if new_loss <= loss - 1e-4 * length * float(slope @ step):
                break
            length *= 0.3
        else:
            break
        if (there - x) @ (new_slope - slope) > 1e-12:
            steps = [*steps[-9:], (there - x, new_slope - slope)]
        x, loss, slope = there, new_loss, new_slope
    return x[:-1], float(x[-1])


def _direction(slope: np.ndarray, curve: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton step for a slope, from the last steps and changes of slope, and a diagonal to begin with."""
    out, parts = slope.copy(), []
    for moved, turned in reversed(steps):
        parts.append((moved @ out) / (moved @ turned))
        out = out - parts[-1] * turned
    out = out / curve
    if steps:
        moved, turned = steps[-1]
        out = out * (moved @ turned) / float((turned * turned / curve).sum())
    for moved, turned in steps:
        out = out + moved * (parts.pop() - (turned @ out) / (moved @ turned))
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col`` in place of any of that name."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop(score_col)
    at = plain.columns.index(text_col)
    schema = plain.withColumn(score_col, F.lit(0.0)).schema

    def run(batches):
        for whole in batches:
            for batch in split_batch(whole):
                scores = shared.value.scores([t or "" for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return plain.mapInArrow(run, schema)
