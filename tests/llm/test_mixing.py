"""Op 6: posteriors on held-out labels, rates against brute force, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perron.llm import mixing


def slow_rates(n, p, wanted, most):
    """Accelerated projected gradient in numpy until nothing moves; the least half squared distance."""
    scale = np.linalg.eigvalsh((n[:, None] * p).T @ p)[-1]
    now = ahead = np.ones(len(n))
    pace = 1.0
    for _ in range(60_000):
        off = (ahead * n) @ p - wanted
        moved = np.clip(ahead - p @ off / scale, 0, most)
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, now, pace = moved + (pace - 1) / following * (moved - now), moved, following
    return 0.5 * float((((now * n) @ p - wanted) ** 2).sum())


@pytest.mark.parametrize("wanted, most", [((0.5, 0.3, 0.2), None), ((0.97, 0.0, 0.03), 1.0), ((0.1, 0.1, 1.6), 2.0), ((0.0, 0.0, 0.0), None), ((0.45, 0.45, 0.4), 1.5)])
def test_rates_are_the_least_squares_optimum(spark, wanted, most):
    rng = np.random.default_rng(3)
    p = rng.dirichlet((0.4, 0.15, 0.1), 300)
    p[100:200] = (0.9, 0.06, 0.04)  # many rows share one posterior
    n = rng.integers(0, 500, 300)
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, p0 double, p1 double, p2 double")
    targets = np.array(wanted) * n.sum()
    y = mixing.fit_rates(table, targets, max_rate=most)
    rates = np.clip(1 - p @ y, 0, most)
    reached = 0.5 * float((((rates * n) @ p - targets) ** 2).sum())
    least = slow_rates(n.astype(float), p, targets, most or np.inf)
    assert reached <= 1.01 * least + 0.5 * (1e-4 * np.linalg.norm(targets)) ** 2 + 1e-6


def test_words_split_at_all_ascii_blanks(spark):
    text = spark.createDataFrame([("a\r\nB\x0bc\r\x0c d\t\u00a0e",), (None,), (" \n",)], "t string")
    assert [r[0] for r in text.select(mixing.words_of(F.col("t"))).collect()] == [["a", "b", "c", "d", "\u00a0e"], [], []]


def test_posteriors_and_targets_on_held_out_rows(spark):
    """Labels of a fifth of the ids are not shown to the fit: posteriors are calibrated on them, clean text stays."""
    sf = "/root/testdata/sf0.1"
    docs, domains = spark.read.parquet(f"{sf}/documents.parquet"), mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    unseen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rates = mixing.mix(docs, domains.where(~unseen), mixing.TARGETS, max_rate=2.0).persist()
    told = mixing.shares(rates, mixing.TARGETS)
    assert all(abs(asked - got) < 0.002 for asked, got in told.values()), told
    held = rates.join(domains.where(unseen), "doc_id").toPandas()
    names = list(mixing.TARGETS)
    p = held[[f"p_{k}" for k in names]].values
    own = np.array([names.index(d) for d in held.domain])
    assert -np.log(p[np.arange(len(own)), own]).mean() < 0.2
    for i in range(3):  # expected against true tokens of a domain
        true = held.n_tokens[own == i].sum()
        assert abs((held.n_tokens * p[:, i]).sum() - true) < 0.25 * true
    safe = mixing.mix(docs, domains.where(~unseen), mixing.SAFE_TARGETS, max_rate=1.0).join(domains.where(unseen), "doc_id").toPandas()
    assert (safe.copies[safe.domain == "clean"] == 1).mean() > 0.98
    assert (safe.copies[safe.domain == "toxic"] == 0).mean() > 0.9


def test_clean_text_stays_also_in_small_corpora(spark):
    sf = "/root/testdata/sf0.01"
    docs, domains = spark.read.parquet(f"{sf}/documents.parquet"), mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    safe = mixing.mix(docs, domains, mixing.SAFE_TARGETS, max_rate=1.0).join(domains, "doc_id").toPandas()
    assert (safe.copies[safe.domain == "clean"] == 1).mean() > 0.98 and (safe.copies[safe.domain == "toxic"] == 0).mean() > 0.6


def test_mixing_reaches_its_targets(spark):
    words = {"a": "apple pear plum grape", "b": "steel iron zinc copper", "c": "river lake sea brook"}
    rows, marks = [], []
    rng = np.random.default_rng(5)
    for i in range(600):
        k = "aaabbc"[i % 6]
        own = rng.choice(words[k].split(), 12)
        other = rng.choice(" ".join(words.values()).split(), 3)
        rows.append((i, " ".join([*own, *other])))
        if i % 2:
            marks.append((i, k))
    docs, domains = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, domain string")
    targets = {"a": 0.2, "b": 0.3, "c": 0.5}
    got = mixing.mix(docs, domains, targets, total=9000.0).toPandas()
    assert (got.rate >= 0).all() and (abs(got.copies - got.rate) < 1).all()
    for k, w in targets.items():
        assert abs((got.rate * got.n_tokens * got[f"p_{k}"]).sum() / 9000 - w) < 0.01
    truth = np.array([list("abc").index("aaabbc"[i % 6]) for i in got.doc_id])
    assert (got[["p_a", "p_b", "p_c"]].values.argmax(axis=1) == truth).mean() > 0.95
    assert np.allclose(got[["p_a", "p_b", "p_c"]].sum(axis=1), 1)


def test_mixing_of_odd_rows(spark, odd_docs, clashing_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(40)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    domains = mixing.label_domains(labels)
    for docs in (odd_docs, clashing_docs):
        rows = mixing.mix(docs, domains, mixing.TARGETS, max_rate=1.0).collect()
        assert len(rows) == docs.count() and all(0 <= r.rate <= 1 and r.copies in (0, 1) for r in rows)
        assert {r.n_tokens for r in rows if r.doc_id in (100, 101, 102)} == {0}
    assert mixing.mix(no_docs, domains, mixing.TARGETS).collect() == []
    rows = mixing.mix(odd_docs, domains.limit(0), mixing.TARGETS, max_rate=2.0).collect()
    assert len({(r.p_clean, r.rate) for r in rows}) == 1 and all(0 <= r.rate <= 2 for r in rows)  # nothing is known of any text
    twice = spark.createDataFrame([(None, "apple pear"), (None, "steel"), (7, "apple pear"), (7, "apple pear")], "doc_id long, text string")
    rows = mixing.mix(twice, domains, mixing.TARGETS).collect()
    assert len(rows) == 4 and len({(r.rate, r.copies) for r in rows if r.doc_id == 7}) == 1
