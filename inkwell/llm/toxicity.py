"""Toxicity scores by weak supervision.

Voters are lexicons and patterns: seed words, ways of writing, and word
beginnings that labelled rows show to be telling.  A generative label model
estimates from the votes on all documents how accurate each voter is and how
votes correlate within each class: the strongest pairs are factors of its
likelihood.  It sees votes only; what labelled rows give is a first accuracy for
each voter, towards which its estimates are drawn.  Its posteriors are the soft
labels of a linear classifier over word-beginning features, which gives the
scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, materialize, small_batches

#: Labelled rows of each label from which voters are induced and the classifier is fitted, about.
FIT_ROWS = 8_000
#: Lengths of the word beginnings that may become features.
PREFIXES = (3, 4, 5, 6)
#: Most features that are induced; a feature needs MIN_ROWS labelled rows and a test statistic of MIN_G2.
FEATURES = 1_500
MIN_ROWS = 3
MIN_G2 = 15.0
#: Induced features that also vote, at most, and the least precision of a voter, bounded from below.
VOTERS = 96
MIN_PRECISION = 0.5
#: Rounds of the label model.
ROUNDS = 8
#: Share of a voter's first accuracy in each of its estimates, and rows by which a pair's rates are drawn to a single voter's.
ANCHOR = 0.5
PRIOR_ROWS = 4.0
#: Least correlation within a class, of voters that become a pair.
MIN_CORRELATION = 0.1
#: Accuracies of seed words and of patterns before any row is seen.
SEED_ACCURACY, PATTERN_ACCURACY = 0.8, 0.3
#: A held-out row: crc32 of its identifier as text, modulo FOLDS, is 0.
FOLDS = 5

#: Lexicon voters before any label is seen: insults in the four languages of the corpus.
SEEDS = {
    "insult_en": "idiot moron stupid scum trash loser pathetic disgusting worthless clown imbecile jerk bastard filth vermin",
    "insult_de": "idiot dummkopf trottel abschaum depp blödmann versager widerlich",
    "insult_fr": "idiot imbécile crétin abruti ordure connard débile minable",
    "insult_es": "idiota imbécil estúpido basura inútil asqueroso escoria payaso",
}
#: Pattern voters: words in capitals in a row, runs of signs, and a seed word that speaks to someone.
PATTERNS = ("shouting", "exclaiming", "accusing")
# Matches begin where a run of capitals does and never go back, so a long run takes linear time.
_SHOUTING = re.compile(r"(?<![A-Z])[A-Z]{4,}+(?:[^A-Za-z]++[A-Z]{4,}+){3}")
_ADDRESS = regex.compile(r"\b(?:you|you're|your|du|ihr|dein|tu|toi|vous|eres|usted)\P{L}+(?:\p{L}+\P{L}+)?$")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept back from learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


_WORD = regex.compile(r"\p{L}+")


def _beginnings(text: str) -> set[str]:
    """The features of a text: the beginnings of its words, a whole word marked by a final space."""
    words = set(_WORD.findall(text.lower()))
    found = {f"{w} " for w in words if len(w) <= 24}
    for k in PREFIXES:
        found.update([w[:k] for w in words if len(w) >= k])
    return found


def _sample(labelled: DataFrame) -> DataFrame:
    """About FIT_ROWS labels of each kind, chosen by a hash: the same at every size of cluster."""
    total = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in total.items():
        share = F.when(F.col("toxic") == label, min(1.0, FIT_ROWS / n)).otherwise(share)
    return labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))


def _families(texts: pd.Series) -> pd.Series:
    """Two hashes of each text, each the least over its five-word shingles: near copies mostly share one."""
    out = []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()
        hashes = {zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
        out.append({"one": min(hashes), "two": min(h * 0x9E3779B1 & 0xFFFFFFFF for h in hashes)})
    return pd.DataFrame(out, columns=["one", "two"])


def _one_of_copies(labelled: DataFrame) -> DataFrame:
    """`labelled` without most near copies: else the words of one text that is copied often would seem telling."""
    keyed = labelled.withColumn("family", F.pandas_udf(_families, "one long, two long")("text")).select("text", "toxic", "family.*")
    return keyed.dropDuplicates(["toxic", "one"]).dropDuplicates(["toxic", "two"]).select("text", "toxic")


def induce(labelled: DataFrame) -> list[tuple[str, int, int]]:
    """Telling word beginnings of `labelled` (doc_id, text, toxic): (feature, toxic rows, other rows).

    The list is ordered by G2, the likelihood-ratio statistic of feature against label, and has at
    most FEATURES entries.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(x["text"], x["toxic"], strict=True):
                for f in _beginnings(text or ""):
                    seen.setdefault(f, [0, 0])[toxic] += 1
            yield pd.DataFrame([(f, a, b) for f, (b, a) in seen.items()], columns=["feature", "a", "b"])

    total = labelled.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    pos, rows = int(total[0] or 0), int(total[1] or 0)
    if not 0 < pos < rows:
        return []
    neg = rows - pos
    counted = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(count, "feature string, a long, b long")
    sums = counted.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") + F.col("b") >= MIN_ROWS)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    n = F.col("a") + F.col("b")
    g2 = part(F.col("a"), n * pos / rows) + part(F.col("b"), n * neg / rows) + part(pos - F.col("a"), (rows - n) * pos / rows) + part(neg - F.col("b"), (rows - n) * neg / rows)
    best = sums.withColumn("g2", g2).filter(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "feature").limit(FEATURES)
    return [(r["feature"], r["a"], r["b"]) for r in best.collect()]


def _precision(a: float, b: float) -> float:
    """Lower bound of a / (a + b), two standard errors down (Wilson)."""
    n = a + b
    p, z = a / n, 2.0
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def choose_voters(features: list[tuple[str, int, int]], skew: float) -> list[int]:
    """Positions of the features that vote; of nested beginnings, only the first that is as precise.

    skew: the odds of toxic rows in the sample against those in the corpus, which precisions are
    brought back to.
    """
    chosen: list[int] = []

    def precision(a: int, b: int) -> float:
        p = _precision(a, b)
        return p / (p + (1 - p) * skew)

    for i, (f, a, b) in enumerate(features):
        p = precision(a, b)
        if p < MIN_PRECISION:
            continue
        nested = (j for j in chosen if f.startswith(features[j][0]) or features[j][0].startswith(f.rstrip()))
        if any(p <= precision(*features[j][1:]) + 0.02 for j in nested):
            continue
        chosen.append(i)
        if len(chosen) == VOTERS:
            break
    return chosen


class _Finder:
    """Which features and seed voters a text has."""

    def __init__(self, features: list[str]) -> None:
        self.first_seed = len(features)
        self.first_pattern = self.first_seed + len(SEEDS)
        #: For each string: the beginnings and the whole words that it is.
        self.strings: dict[str, tuple[list[int], list[int]]] = {}
        seeds = [(f"{w} ", self.first_seed + i) for i, name in enumerate(SEEDS) for w in SEEDS[name].split()]
        for f, i in [*((f, i) for i, f in enumerate(features)), *seeds]:
            self.strings.setdefault(f.rstrip(), ([], []))[f.endswith(" ")].append(i)
        self.machine = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "machine": None}

    def find(self, text: str) -> list[int]:
        if self.machine is None:
            machine = ahocorasick.Automaton()
            for f, (begins, words) in self.strings.items():
                machine.add_word(f, (len(f), begins, words))
            machine.make_automaton()
            self.machine = machine
        low, found = text.lower(), set()
        size = len(low)
        for end, (k, begins, words) in self.machine.iter(low):
            at = end - k
            if at < 0 or not low[at].isalpha():
                found.update(begins)
                if words and (end + 1 == size or not low[end + 1].isalpha()):
                    found.update(words)
                    if words[-1] >= self.first_seed and _ADDRESS.search(low[max(0, at - 40) : at + 1]):
                        found.add(self.first_pattern + 2)
        if _SHOUTING.search(text):
            found.add(self.first_pattern)
        if "!!!" in text or "???" in text:
            found.add(self.first_pattern + 1)
        return sorted(found)


class LabelModel:
    """A forest of voters: a voter fires at a rate that depends on the class and on whether its parent fires.

    rates[v] is P(v fires | class, parent) as [[clean and the parent stays out, clean and it fires], the same of toxic];
    a voter without a parent has equal rates in both columns.  A row's odds are those of the
    voters that fire.  That a voter stays out says nothing, since voters know one language each; that all
    stay out is a vote of its own, with the share `quiet` of toxic rows.
    """

    def __init__(self, prior: float, quiet: float, rates: dict[int, np.ndarray], parent: dict[int, int]) -> None:
        self.parent = parent
        fires = {v: np.log(q[1] / q[0]) for v, q in rates.items()}
        #: Log odds before any vote, of a row without votes, what each vote adds, and what it adds if its parent votes too.
        self.base, self.quiet = float(np.log(prior / (1 - prior))), float(np.log(quiet / (1 - quiet)))
        self.alone = {v: float(x[0]) for v, x in fires.items()}
        self.both = {v: float(fires[v][1] - fires[v][0]) for v in parent}

    def odds(self, votes: Column) -> Column:
        """Log odds that a row with these votes is toxic."""
        if not self.alone:
            return F.lit(self.quiet)
        alone = F.create_map(*[F.lit(x) for kv in self.alone.items() for x in kv])
        out = F.aggregate(votes, F.lit(self.base), lambda s, v: s + F.element_at(alone, v))
        if self.parent:
            up = F.create_map(*[F.lit(x) for kv in self.parent.items() for x in kv])
            both = F.create_map(*[F.lit(x) for kv in self.both.items() for x in kv])
            met = F.filter(votes, lambda v: F.coalesce(F.array_contains(votes, F.try_element_at(up, v)), F.lit(False)))
            out = out + F.aggregate(met, F.lit(0.0), lambda s, v: s + F.element_at(both, v))
        return F.when(F.size(votes) == 0, self.quiet).otherwise(out)


def _forest(voters: list[int], n: np.ndarray, toxic: np.ndarray, total: float, all_toxic: float) -> dict[int, int]:
    """Parents of a spanning forest of the strongest pairs, by the information that votes share within the classes.

    n and toxic: rows, and expected toxic rows, on which two voters fire; the diagonal is of single voters.
    """
    shared = np.zeros(n.shape)
    strong = np.zeros(n.shape, bool)
    for joint, rows in ((toxic, all_toxic), (n - toxic, total - all_toxic)):
        if rows <= 0:
            continue
        p11 = joint / rows
        p = np.diag(p11)
        cells = ((p11, p[:, None] * p), (p[:, None] - p11, p[:, None] * (1 - p)), (p - p11, (1 - p[:, None]) * p), (1 - p[:, None] - p + p11, (1 - p[:, None]) * (1 - p)))
        for x, expected in cells:
            x = np.maximum(x, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                shared += rows / total * np.where((x > 0) & (expected > 0), x * np.log(x / expected), 0)
        spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-300))
        strong |= (p11 - np.outer(p, p)) / spread >= MIN_CORRELATION
    i, j = np.nonzero(np.triu(strong, 1))
    tree = list(range(len(voters)))

    def root(x: int) -> int:
        while tree[x] != x:
            x = tree[x]
        return x

    near: dict[int, list[int]] = {}
    for a, b in sorted(zip(i.tolist(), j.tolist(), strict=True), key=lambda x: (-round(float(shared[x]), 10), x)):
        if (ra := root(a)) != (rb := root(b)):
            tree[ra] = rb
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    parent: dict[int, int] = {}
    seen: set[int] = set()
    for start in range(len(voters)):
        todo = [] if start in seen else [start]
        seen.add(start)
        while todo:
            u = todo.pop()
            for v in near.get(u, []):
                if v not in seen:
                    seen.add(v)
                    parent[voters[v]] = voters[u]
                    todo.append(v)
    return parent


def label_model(rows: DataFrame, voters: list[int], start: dict[int, float], prior: float, quiet: float) -> LabelModel:
    """The label model of `rows` (found: features and voters), by expectation maximisation.

    A voter votes toxic or abstains.  start: the accuracy of each voter, the share of toxic rows among those
    it votes on, before any vote is seen; prior and quiet: the shares of toxic rows in all and among those
    without votes.  Voters are independent at
    first.  With the posteriors of that model, the pairs that go together most within the classes
    become the edges of a forest.  Then expectation gives each row a posterior by its votes, and
    maximisation gives each voter its rates by class and parent.  No row's label is used.

    Rows with equal votes are counted together first.  Each round sends two rows for each voter
    to the driver, and the forest one row for each pair of voters that meet.
    """
    ids = F.array(*map(F.lit, voters)).cast("array<int>")
    votes = materialize(rows.select(F.array_intersect("found", ids).alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "votes")
    fired = {r["v"]: r["n"] for r in votes.select(F.explode("votes").alias("v"), "n").groupBy("v").agg(F.sum("n").alias("n")).collect()}
    total = votes.agg(F.sum("n")).first()[0] or 0
    voters = [v for v in voters if fired.get(v)]
    if not voters:
        discard(votes)
        return LabelModel(prior, quiet, {}, {})
    start = {v: min(max(start[v], 1e-3), 1 - 1e-3) for v in voters}

    def single(v: int) -> np.ndarray:
        clean, toxic = (1 - start[v]) * fired[v] / (1 - prior) / total, start[v] * fired[v] / prior / total
        return np.repeat(np.minimum([[clean], [toxic]], 0.99), 2, axis=1)

    model = LabelModel(prior, quiet, {v: single(v) for v in voters}, {})
    place = {v: i for i, v in enumerate(voters)}

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joint = np.zeros((2, len(place), len(place)))
        for x in batches:
            for own, n, e in zip(x["votes"], x["n"], x["e"], strict=True):
                at = [place[v] for v in own]
                joint[0][np.ix_(at, at)] += n
                joint[1][np.ix_(at, at)] += e
        i, j = np.nonzero(joint[0])  # a task hands on no more than the matrix
        yield pd.DataFrame({"i": i, "j": j, "n": joint[0][i, j], "e": joint[1][i, j]})

    def expected(model: LabelModel) -> DataFrame:
        return votes.select("votes", "n", (F.col("n") / (1 + F.exp(-model.odds(F.col("votes"))))).alias("e"))

    pairs = expected(model).filter("size(votes) > 0").mapInPandas(meet, "i long, j long, n double, e double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    joint = np.zeros((2, len(voters), len(voters)))
    for r in pairs.collect():
        joint[:, r["i"], r["j"]] = r["n"], r["e"]
    parent = _forest(voters, *joint, total, expected(model).agg(F.sum("e")).first()[0])
    up = F.create_map(*[F.lit(x) for kv in parent.items() for x in kv]) if parent else None
    before: dict[int, np.ndarray] = {}
    for _ in range(ROUNDS):
        each = expected(model).select(F.explode(F.concat("votes", F.array(F.lit(-1)))).alias("v"), "votes", "n", "e")
        met = F.coalesce(F.array_contains("votes", F.try_element_at(up, F.col("v"))), F.lit(False)) if parent else F.lit(False)
        sums = each.groupBy("v", met.alias("met")).agg(F.sum("n").alias("n"), F.sum("e").alias("e")).collect()
        rates = maximised({(r["v"], r["met"]): (float(r["n"]), r["e"]) for r in sums}, voters, parent, start)
        model = LabelModel(prior, quiet, rates, parent)
        if before and max(float(np.abs(np.log(rates[v] / before[v])).max()) for v in voters) < 1e-3:
            break
        before = rates
    discard(votes)
    return model


def maximised(sums: dict[tuple[int, bool], tuple[float, float]], voters: list[int], parent: dict[int, int], start: dict[int, float]) -> dict[int, np.ndarray]:
    """Rates of each voter from (rows, expected toxic rows) by voter and whether its parent fires too; voter -1 stands for all rows."""
    total, all_toxic = sums[-1, False]
    rows = np.array([max(total - all_toxic, 1e-9), max(all_toxic, 1e-9)])  # clean, toxic

    def split(n: float, e: float) -> np.ndarray:
        return np.array([n - e, e])

    fires = {}
    for v in voters:
        n = sum(sums.get((v, m), (0.0, 0.0))[0] for m in (False, True))
        e = sum(sums.get((v, m), (0.0, 0.0))[1] for m in (False, True))
        fires[v] = split(n, (1 - ANCHOR) * e + ANCHOR * n * start[v])
    out = {}
    for v in voters:
        rate = np.clip(fires[v] / rows, 1e-6, 0.99)
        out[v] = np.repeat(rate[:, None], 2, axis=1)
        if v in parent:
            u = fires[parent[v]]
            n, e = sums.get((v, True), (0.0, 0.0))
            # Both fire: as toxic as the voters' own anchors make them.
            share = (1 - ANCHOR) * e / n + ANCHOR * max(start[v], start[parent[v]]) if n else 0.0
            both = np.minimum(split(n, n * share), np.minimum(fires[v], u))
            out[v][:, 1] = (both + PRIOR_ROWS * rate) / (u + PRIOR_ROWS)
            out[v][:, 0] = (fires[v] - both + PRIOR_ROWS * rate) / (np.maximum(rows - u, 0) + PRIOR_ROWS)
            out[v] = np.clip(out[v], 1e-6, 1 - 1e-6)
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_votes) for each row of `docs`.

    `labels` has doc_id and toxic (0 or 1; other values and nulls are ignored; of several labels of
    one row the largest counts).  Only rows that are not held out teach; labels and identifiers are
    no input of a score.  score is from 0 to 1, predicted is 1 from 0.5 on.

    A null text counts as empty; an empty text gets the score of a text without features.  Equal
    texts have equal scores; repeated rows are kept.  A null identifier is not held out and has no
    label.  Other columns are ignored.  Without labelled rows of both kinds the seed voters alone
    teach.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The labels are sampled before they meet the texts: about 2 * FIT_ROWS of them, a fixed size, go to all executors.
    sample = materialize(_one_of_copies(rows.join(F.broadcast(_sample(known)), "doc_id")), "labelled")
    features = induce(sample)
    counts = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    rate = known.agg(F.avg("toxic")).first()[0]
    prior = float(min(max(rate if rate is not None else 0.1, 0.01), 0.5))
    odds = (counts[0] / (counts[1] - counts[0])) / (prior / (1 - prior)) if features else 1.0
    induced = choose_voters(features, odds)
    n = len(features)
    seeds = list(range(n, n + len(SEEDS) + len(PATTERNS)))
    voters = [*induced, *seeds]
    finder = docs.sparkSession.sparkContext.broadcast(_Finder([f for f, _, _ in features]))  # at most FEATURES words

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "found": [finder.value.find(t) for t in x["text"]]})

    # A row to a document; the texts are not needed any more.
    found = materialize(rows.mapInPandas(find, "doc_id long, found array<int>"), "features")
    start = dict.fromkeys(voters, SEED_ACCURACY) | dict.fromkeys(range(n + len(SEEDS), n + len(SEEDS) + len(PATTERNS)), PATTERN_ACCURACY)
    quiet = prior
    if features:
        for v, a, b in _counted(sample, find, voters).collect():
            if v < 0:
                quiet = _posterior_rate(a, b, counts, prior)
            elif v < n or a + b >= MIN_ROWS:
                start[v] = _posterior_rate(a, b, counts, prior)
    discard(sample)
    model = label_model(found, voters, start, prior, quiet)
    votes = F.array_intersect("found", F.array(*map(F.lit, voters)).cast("array<int>"))
    voted = found.withColumn("votes", votes)
    size = n + len(seeds)
    coef, intercept = _fit(voted.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))), model, size)
    linear = F.array(*[F.lit(float(c)) for c in coef])
    logit = F.aggregate("found", F.lit(float(intercept)), lambda s, i: s + F.element_at(linear, i + 1))
    scored = voted.select("doc_id", F.size("votes").cast("long").alias("n_votes"), (1 / (1 + F.exp(-logit))).alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_votes")


def _counted(sample: DataFrame, find: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], voters: list[int]) -> DataFrame:
    """(v, a, b): the toxic and other rows of the sample on which each voter fires; v is -1 for those on which none does."""
    texts = sample.select(F.col("toxic").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    votes = F.array_intersect("found", F.array(*map(F.lit, voters)).cast("array<int>"))
    each = texts.mapInPandas(find, "doc_id long, found array<int>").select(F.col("doc_id").alias("toxic"), F.explode_outer(votes).alias("v"))
    return each.groupBy(F.coalesce("v", F.lit(-1)).alias("v")).agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))


def _posterior_rate(a: int, b: int, counts: tuple, prior: float) -> float:
    """Share of toxic rows among those with a feature, with the labels' sample weighted back to the prior."""
    pos, total = counts
    toxic, clean = (a + 0.5) / (pos + 1) * prior, (b + 0.5) / (total - pos + 1) * (1 - prior)
    return float(toxic / (toxic + clean))


def _fit(rows: DataFrame, model: LabelModel, size: int) -> tuple[list[float], float]:
    """Linear classifier over the features, fitted to the label model's posteriors of about 2 * FIT_ROWS rows.

    Half of the rows have votes and half have none, weighted back to their shares.  Each row counts
    twice, as toxic with its posterior's weight and as clean with the rest.
    """
    voted = F.size("votes") > 0
    total = {r["v"]: r["n"] for r in rows.groupBy(voted.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return [0.0] * size, 0.0
    share = F.when(voted, min(1.0, FIT_ROWS / total.get(True, 1))).otherwise(min(1.0, FIT_ROWS / total.get(False, 1)))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("w", 1 / share)
    p = 1 / (1 + F.exp(-model.odds(F.col("votes"))))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), p.alias("p")), F.struct(F.lit(0.0).alias("label"), (1 - p).alias("p"))))
    vector = F.udf(lambda found: Vectors.sparse(size, found, [1.0] * len(found)), VectorUDT())  # a bounded number of rows
    data = sample.select("found", "w", both.alias("x")).select("found", F.col("x.label").alias("label"), (F.col("w") * F.col("x.p")).alias("w"))
    data = data.groupBy("found", "label").agg(F.sum("w").alias("w")).filter("w > 0")
    training = data = materialize(data, "training")
    mean = data.agg(F.avg("w")).first()[0]
    data = data.select(vector("found").alias("features"), "label", (F.col("w") / mean).alias("w")).cache()
    model = LogisticRegression(maxIter=40, regParam=1e-4, standardization=False, weightCol="w").fit(data)
    data.unpersist()
    discard(training)
    return [float(c) for c in model.coefficients], float(model.intercept)
