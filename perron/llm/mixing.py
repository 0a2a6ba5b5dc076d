"""Op 6: mix documents to target weights by soft membership. DataFrame functions only on executors.

A classifier learns domains from a labelled table. Features of a text are the heads and ends of its words by hash; only
features that deviate tellingly between domains have weights (naive Bayes log-ratios), and those are broadcast if they
are few. A multinomial logistic step on labelled rows that the weights have not seen turns the summed log-ratios of a text
into calibrated posteriors.

Rates r >= 0 then fit E_k = sum_d r_d n_d p_dk to the targets T_k in least squares by projected gradient. The gradient of a
rate is n_d p_d . (E - T), so with steps of length t / n_d a step from 1 is r = P(1 - p . y) with the K-vector
y = t (E - T). The gradient is taken at the end of the step (an implicit step, stable for any t): y solves
y = t (E(P(1 - p . y)) - T), the condition of a smooth convex problem in K unknowns, and Newton steps find it. Each is one
distributed aggregation for several step lengths. t grows tenfold until the totals match or the gap to the optimum is
small. A rate is a function of posterior and y alone, so no state is written between steps.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Largest table of weights, or of sampled ids, that is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Least deviation of a feature from its expected count, in standard deviations, that gives it weights.
TELLING = 4.0
HEAD = 4
MARKS = ".,;:!?\"()"


def words_of(text: Column) -> Column:
    """Words of a text: runs without ASCII white space, lower-cased."""
    flat = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.filter(F.split(F.lower(flat), " "), lambda w: w != "")


def features(docs: DataFrame, keys: list[str], text_column: str) -> DataFrame:
    """A row for each distinct feature of a row of ``docs``: the keys, n_tokens and the feature's hash b.

    Features are the first ``HEAD`` characters of words without closing marks, whether a head comes at least twice and
    four times, the last two characters of words, and the share of distinct words in eighths. A text without words has
    one row with a null hash.
    """
    counted = docs.select(*keys, words_of(F.col(text_column)).alias("words"))
    heads = F.sort_array(F.transform("words", lambda w: F.xxhash64(F.left(F.rtrim(w, F.lit(MARKS)), F.lit(HEAD)))))
    ends = F.array_distinct(F.transform("words", lambda w: F.xxhash64(F.lit("end"), F.right(w, F.lit(2)))))
    variety = F.floor(F.size(F.array_distinct("words")) * 8 / F.greatest(F.size("words"), F.lit(1)))
    held = counted.select(*keys, F.size("words").cast("long").alias("n_tokens"), heads.alias("heads"), ends.alias("ends"), F.xxhash64(F.lit("variety"), variety).alias("variety"))
    times = lambda n: F.transform(F.array_distinct(F.filter("heads", lambda h, i: F.get("heads", i + (n - 1)) == h)), lambda h: F.xxhash64(F.lit(n), h))
    bag = F.concat(F.array_distinct("heads"), times(2), times(4), F.col("ends"), F.array("variety"))
    each = held.select(*keys, "n_tokens", F.when(F.col("n_tokens") > 0, bag).alias("bag"))
    return each.select(*keys, "n_tokens", F.explode_outer("bag").alias("b"))


def learn(docs: DataFrame, domains: DataFrame, names: list[str], *, sample: int, text_column: str, smooth: float = 5.0) -> tuple[DataFrame, list[float], DataFrame]:
    """Weights by feature, log priors, and the labelled rows set aside for calibration.

    ``domains`` is (doc_id, domain). At most about ``sample`` labelled ids are used, chosen by a hash of the id.
    """
    known = domains.where(F.col("domain").isin(names)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    spot = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1_000_000)) / 1e6
    picked = shared.written(known.where(spot("sample") < share), "sample")
    few = picked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    chosen = docs.select("doc_id", F.col(text_column).alias("text")).join(F.broadcast(picked) if few else picked, "doc_id")
    # a text that many documents copy counts once, else all its words would tell of its domain
    once = chosen.groupBy(F.xxhash64("text").alias("h"), "domain").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.doc_id", "d.text", "domain")
    chosen = shared.written(once.withColumn("aside", spot("aside") < 0.25), "labelled")
    fit = chosen.where(~F.col("aside"))
    totals = {r.domain: r.n for r in fit.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    count = sum(totals.values())
    priors = [math.log((totals.get(k, 0) + 1) / (count + len(names))) for k in names]
    each = features(fit, ["domain"], "text")
    table = each.where("b is not null").groupBy("b").agg(*[F.sum((F.col("domain") == k).cast("double")).alias(f"c{i}") for i, k in enumerate(names)])
    table = shared.written(table, "domain-counts")
    sums = table.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(len(names))]).first()
    every = max(sum(sums), 1.0)
    whole = sum([F.col(f"c{i}") for i in range(1, len(names))], F.col("c0"))
    # observed against expected documents, both raised by ``smooth``; only features that deviate tellingly get weights,
    # else the small deviations of a text's many rare words would drown its few telling ones
    expected = [whole * (x / every) for x in sums]
    telling = [F.abs(F.col(f"c{i}") - e) / F.sqrt(e + 1.0) > TELLING for i, e in enumerate(expected)]
    weight = [F.log((F.col(f"c{i}") + smooth) / (e + smooth)) for i, e in enumerate(expected)]
    telling_features = table.where(functools.reduce(operator.or_, telling)).select("b", *[w.alias(f"w{i}") for i, w in enumerate(weight)])
    return shared.written(telling_features, "domain-weights"), priors, chosen.where("aside")


def evidence(docs: DataFrame, weights: DataFrame, keys: list[str], k: int, text_column: str) -> DataFrame:
    """keys, n_tokens and the summed log-ratios l0..: one row for each distinct ``keys``."""
    few = weights.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    each = features(docs, keys, text_column).join(F.broadcast(weights) if few else weights, "b", "left")
    return each.groupBy(*keys, "n_tokens").agg(*[F.sum(F.coalesce(F.col(f"w{i}"), F.lit(0.0))).alias(f"l{i}") for i in range(k)])


def inputs(k: int) -> list[Column]:
    """Inputs of the logistic step: log-ratios, the roots of their positive parts, 1."""
    sums = [F.col(f"l{i}") for i in range(k)]
    return [*sums, *[F.sqrt(F.greatest(x, F.lit(0.0))) for x in sums], F.lit(1.0)]


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    powers = [F.exp(x - top) for x in logits]
    return [p / sum(powers[1:], powers[0]) for p in powers]


def posterior(coefficients: np.ndarray) -> list[Column]:
    """Posteriors from the columns l0..; a text without telling features has what the constants give."""
    k = coefficients.shape[1]
    return softmax([functools.reduce(operator.add, [x * F.lit(float(c)) for x, c in zip(inputs(k), coefficients[:, i])]) for i in range(k)])


def calibrate(aside: DataFrame, weights: DataFrame, priors: list[float], names: list[str], *, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients (2K + 1, K) of a multinomial logistic regression on the rows set aside, drawn by ``ridge`` towards
    the log-ratios as they are and the priors.

    Steps are scaled by the bound of the curvature (half the second moments of the inputs) and accelerated; a round is
    one aggregation over the rows set aside.
    """
    k, size = len(priors), 2 * len(priors) + 1
    start = np.vstack([0.5 * np.eye(k), np.zeros((k, k)), np.array(priors)[None, :]])
    told = evidence(aside, weights, ["doc_id", "domain"], k, "text")
    held = shared.written(told.select(F.array(*inputs(k)).alias("x"), "domain"), "calibration")
    x = [F.get("x", F.lit(i)) for i in range(size)]
    sums = held.agg(F.count("*").alias("n"), *[F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)]).first()
    if not sums.n:
        return start
    moments = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    unit = np.sqrt(np.diag(moments) / sums.n) + 1e-6
    bound = np.linalg.inv(moments / np.outer(unit, unit) / 2 + ridge * np.eye(size))

    def gradient(b: np.ndarray) -> tuple[float, np.ndarray]:
        c = b / unit[:, None]
        # arrays of literals keep the generated code the same from round to round
        logit = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c[:, i]]), operator.mul), F.lit(0.0), operator.add) for i in range(k)]
        told = held.select("x", "domain", *[z.alias(f"z{i}") for i, z in enumerate(logit)])
        told = told.select("x", "domain", *[p.alias(f"p{i}") for i, p in enumerate(softmax([F.col(f"z{i}") for i in range(k)]))])
        off = [F.col(f"p{i}") - (F.col("domain") == n).cast("double") for i, n in enumerate(names)]
        own = functools.reduce(operator.add, [F.when(F.col("domain") == n, F.col(f"p{i}")).otherwise(0.0) for i, n in enumerate(names)])
        got = told.agg(F.sum(-F.log(F.greatest(own, F.lit(1e-300)))).alias("loss"), *[F.sum(x[j] * off[i]).alias(f"g{j}_{i}") for j in range(size) for i in range(k)]).first()
        g = np.array([[got[f"g{j}_{i}"] for i in range(k)] for j in range(size)]) / unit[:, None]
        drawn = b - start * unit[:, None]
        return got.loss + ridge / 2 * float((drawn**2).sum()), g + ridge * drawn

    now = ahead = start * unit[:, None]
    pace, last = 1.0, math.inf
    for _ in range(rounds):
        loss, g = gradient(ahead)
        moved = ahead - bound @ g
        if loss > last:  # the momentum went too far
            ahead, pace = moved, 1.0
        else:
            following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
            ahead, pace = moved + (pace - 1) / following * (moved - now), following
        now = moved
        if abs(last - loss) < 1e-3 * loss:
            break
        last = loss
    return now / unit[:, None]


def rate_of(along: Column, max_rate: float | None) -> Column:
    """1 - p . y projected to 0..max_rate."""
    rate = F.greatest(1.0 - along, F.lit(0.0))
    return rate if max_rate is None else F.least(rate, F.lit(float(max_rate)))


def along(k: int, v: Column) -> Column:
    return functools.reduce(operator.add, [F.col(f"p{i}") * F.get(v, F.lit(i)) for i in range(k)])


def literal(v: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def fit_rates(table: DataFrame, wanted: np.ndarray, *, max_rate: float | None, tolerance: float = 1e-4, gap: float = 2e-3, stages: int = 8, newton: int = 8) -> np.ndarray:
    """The y whose rates bring the expected totals of ``table`` (n_tokens, p0..) to ``wanted`` in least squares.

    Done when the totals are within ``tolerance`` of the targets (as a share of their length), or the gap to the optimum
    is at most ``gap`` of half the squared distance. The gap is bounded by the gain that the gradient promises over all
    admissible rates; without a bound, rates up to twice the largest one count as admissible.
    """
    k = len(wanted)
    p, n = [F.col(f"p{i}") for i in range(k)], F.col("n_tokens")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def at(tries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        """Totals, moments of the rates within the bounds, sum of the potential and largest rate for each y."""
        # tries are an array of literals, so the generated code is the same in every round
        each = table.select("*", F.posexplode(F.array(*[literal(y) for y in tries])).alias("try", "y"))
        each = each.withColumn("x", 1.0 - along(k, F.col("y")))
        each = each.withColumn("rate", rate_of(1.0 - F.col("x"), max_rate))
        free = (F.col("x") > 0) if max_rate is None else (F.col("x") > 0) & (F.col("x") < max_rate)
        potential = F.col("rate") * (F.col("x") - F.col("rate") / 2)  # its slope along x is the rate
        got = each.groupBy("try").agg(
            F.max("rate").alias("top"), F.sum(n * potential).alias("h"), *[F.sum(F.col("rate") * n * p[i]).alias(f"e{i}") for i in range(k)],
            *[F.sum(F.when(free, n * p[i] * p[j]).otherwise(0.0)).alias(f"m{i}_{j}") for i, j in pairs],
        )
        found = {r["try"]: r for r in got.collect()}
        return [
            (np.array([found[t][f"e{i}"] for i in range(k)]), np.array([[found[t][f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), found[t].h, found[t].top)
            for t in range(len(tries))
        ]

    def promised(y: np.ndarray, g: np.ndarray, top: float) -> float:
        most = float(max_rate) if max_rate is not None else 2 * max(top, 1.0)
        rows = table.select("*", rate_of(along(k, literal(y)), max_rate).alias("rate"), along(k, literal(g)).alias("slope"))
        gain = F.when(F.col("slope") > 0, F.col("rate")).otherwise(F.col("rate") - most) * F.col("slope")
        return rows.agg(F.sum(n * gain)).first()[0]

    y = np.zeros(k)
    unit = (table.agg(F.sum(n * functools.reduce(operator.add, [x * x for x in p]))).first()[0] or 0.0) / k
    if not unit:
        return y
    e, moments, h, top = at([y])[0]
    size = float(np.linalg.norm(wanted))
    for stage in range(stages):
        length = 10.0 ** (stage + 1) / unit
        value = lambda y, h: float(y @ y / (2 * length) + y @ wanted + h)  # noqa: B023, E731
        for _ in range(newton):
            slope = y / length - e + wanted
            if np.linalg.norm(slope) <= 1e-3 * np.linalg.norm(e - wanted) + 1e-9 * size:
                break
            step = np.linalg.solve(np.eye(k) / length + moments, slope)
            tries = [y - t * step for t in (1.0, 0.5, 0.2, 0.05, 0.01)]
            found = at(tries)
            best = min(range(len(tries)), key=lambda j: value(tries[j], found[j][2]))
            if value(tries[best], found[best][2]) >= value(y, h):
                break
            y, (e, moments, h, top) = tries[best], found[best]
        off = e - wanted
        if np.linalg.norm(off) <= tolerance * size or promised(y, off, top) <= gap * 0.5 * float(off @ off):
            break
    return y


def mix(
    docs: DataFrame,
    domains: DataFrame,
    targets: dict[str, float],
    *,
    text_column: str = "text",
    anchor: str | None = None,
    total: float | None = None,
    max_rate: float | None = None,
    sample: int = 20_000,
) -> DataFrame:
    """(doc_id, text_hash, n_tokens, p_<domain>..., rate, copies) for each row of ``docs``.

    ``targets`` are weights of domains in the token total ``total``; without it the total is what asks the ``anchor``
    domain (default: the largest weight) for its natural tokens. Targets that rates up to ``max_rate`` cannot meet are
    met in least squares; ``shares`` tells what was reached. n_tokens counts words between ASCII white space. copies is
    the rate rounded to a neighbouring integer by a hash of id and text, so that its expectation is the rate. Null and
    empty texts have 0 tokens, the posterior of a text without telling features and a rate like any other; null ids keep
    a row; repeated rows have a row each. An empty table gives no rows. Other columns are not read.
    """
    names = list(targets)
    k = len(names)
    weights, priors, aside = learn(docs, domains, names, sample=sample, text_column=text_column)
    coefficients = calibrate(aside, weights, priors, names)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text_column).alias("text"))
    told = evidence(rows, weights, ["row", "doc_id", "text_hash"], k, "text")
    table = shared.written(told.select("doc_id", "text_hash", "n_tokens", *[p.alias(f"p{i}") for i, p in enumerate(posterior(coefficients))]), "posteriors")
    held = table.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{i}")), F.lit(0.0)).alias(f"n{i}") for i in range(k)]).first()
    share = np.array([targets[x] for x in names], float)
    share = share / share.sum()
    if total is None:
        a = names.index(anchor or max(targets, key=targets.get))
        total = held[f"n{a}"] / share[a]
    y = fit_rates(table, total * share, max_rate=max_rate)
    spot = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text_hash"), F.lit(1_000_000_007)) / 1_000_000_007.0
    out = table.withColumn("rate", rate_of(along(k, literal(y)), max_rate))
    whole = F.floor("rate")
    copies = (whole + (spot < F.col("rate") - whole).cast("long")).cast("int")
    return out.select("doc_id", "text_hash", "n_tokens", *[F.col(f"p{i}").alias(f"p_{n}") for i, n in enumerate(names)], "rate", copies.alias("copies"))


def shares(rates: DataFrame, targets: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Target and reached share of the expected tokens of each domain, for a table made by ``mix``."""
    got = rates.agg(*[F.coalesce(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{n}")), F.lit(0.0)).alias(n) for n in targets]).first()
    whole, asked = max(sum(got), 1e-12), sum(targets.values())
    return {n: (t / asked, got[n] / whole) for n, t in targets.items()}


#: Weights of the production mix: mostly clean text, little of what is marked toxic or low in quality.
TARGETS = {"clean": 0.94, "toxic": 0.03, "junk": 0.025, "junk_toxic": 0.005}

#: Weights of the pipeline: nothing toxic.
SAFE_TARGETS = {"clean": 0.99, "toxic": 0.0, "junk": 0.01, "junk_toxic": 0.0}


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: the four combinations of quality and toxic."""
    junk, toxic = F.col("quality") == 0, F.col("toxic") == 1
    domain = F.when(junk & toxic, "junk_toxic").when(junk, "junk").when(toxic, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
