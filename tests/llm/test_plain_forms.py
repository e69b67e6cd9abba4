"""Folds, statistics, splits, word counts and the risk's gradient against plain forms of them."""

import math
import pathlib
import re
import shutil
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.llm.util import ODD, documents, prose, words

from tessera.llm import katz, labelled, quality, toxicity
from tessera.llm.common import settle


def as_bytes(texts):
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_folds(spark):
    ids = [None, 0, 1, 7, 123_456_789, -5, 2**63 - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", labelled.fold().alias("fold"), katz.held_out().alias("held")).collect()
    for r in rows:
        crc = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode())
        assert r.fold == crc % 5 and r.held == (crc % 7 == 2)


def shares(items):
    n, counts = len(items), Counter(items)
    return [n, len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1)]


def plain_statistics(text):
    raw = (text or "").encode()
    kind = lambda b: 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b == 32 or 9 <= b <= 13 else 4 if chr(b) in ".,;:'\"-?" else 5 if b == 33 else 6 if chr(b) in "|[]{}()<>" else 7 if 33 <= b < 127 else 9 if 128 <= b < 192 else 10 if b >= 192 else 8
    counts = Counter(map(kind, raw))
    found = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    low = words(text)
    lines = [x for x in (text or "").translate({i: i + 32 for i in range(65, 91)}).split("\n") if x]
    total = max(len(found), 1)
    marks = [sum(4 <= kind(b) <= 7 for b in w) for w in found]
    share = lambda test: sum(map(test, found)) / total
    mean = sum(map(len, found)) / total
    grams = [tuple(low[i : i + 3]) for i in range(len(low) - 2)] if len(low) >= 3 else [tuple(low)] if low else []
    return [
        math.log1p(len(raw)), *(counts[k] / max(len(raw), 1) for k in range(11)), mean, math.sqrt(max(sum(len(w) ** 2 for w in found) / total - mean**2, 0)),
        share(lambda w: not any(kind(b) == 1 for b in w)), share(lambda w: 5 <= kind(w[-1]) <= 7), share(lambda w: kind(w[-1]) == 4), share(lambda w: kind(w[0]) == 0),
        sum(m >= 2 for m in marks) / total, sum(m == len(w) for m, w in zip(marks, found, strict=True)) / total, share(lambda w: len(w) == 1), share(lambda w: len(w) > 20),
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / total, len(found) / max(len(lines), 1), *shares(low), *shares(lines), *shares(grams),
    ]


def test_statistics():
    texts = [*ODD, "Buy NOW!! (cheap) | cheap\nBuy NOW!! 12 34\n\nend.", prose(1, 90) + "\n" + prose(2, 5)]
    got = quality.statistics(*as_bytes(texts))
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-9)


def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(6)
    x, y = np.round(r.normal(size=(300, 4)), 1), (r.random(300) < 0.4).astype(float)
    y[x[:, 2] > 0.3] = 1
    model = quality.boost(x, y, trees=1, depth=1, bins=64)
    p = 1 / (1 + math.exp(-model.base))
    g, h = p - y, np.full(300, p * (1 - p))
    best = (0, 0, 0)
    for j in range(4):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])):
            right = x[:, j] > cut
            if min(h[right].sum(), h[~right].sum()) >= 2:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (right, ~right)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, j, cut))
    assert model.feature[0, 0] == best[1] and model.cut[0, 0] == best[2]
    right = x[:, best[1]] > best[2]
    assert np.allclose(model.leaf[0], [-0.15 * g[s].sum() / (h[s].sum() + 1) for s in (~right, right)])


def plain_risk(theta, dense, positive, weight, prior):
    margin = dense @ theta[:-1] + theta[-1]
    loss = np.logaddexp(0, margin)
    mean = lambda v, s: (weight[s] * v[s]).sum() / weight[s].sum()
    rest = mean(loss, ~positive) - prior * mean(loss, positive)
    return prior * mean(np.logaddexp(0, -margin), positive) + rest if rest >= 0 else -rest


def test_gradient():
    """One step of plain descent along the gradient that the sums give, against differences of the risk itself."""
    r = np.random.default_rng(3)
    dense = (r.random((60, 5)) < 0.4).astype(float)
    rows, cols = np.nonzero(dense)
    positive, weight = np.arange(60) < 20, r.integers(1, 5, 60).astype(float)
    for theta in (r.normal(size=6), np.array([3.0, 3, 3, 3, 3, 4])):
        for prior in (0.2, 0.85):
            parts = toxicity.sums(theta, rows, cols, positive, weight)
            half_p, half_u = np.split(parts, 2)
            loss_p, score_p, count_p = half_p[0], half_p[1:7], half_p[7:]
            loss_u, score_u, count_u = half_u[0], half_u[1:7], half_u[7:]
            rest = loss_u / count_u[-1] - prior * loss_p / count_p[-1]
            slope = score_u / count_u[-1] - prior * count_p / count_p[-1] if rest >= 0 else prior * score_p / count_p[-1] - score_u / count_u[-1]
            numeric = [(plain_risk(theta + d, dense, positive, weight, prior) - plain_risk(theta - d, dense, positive, weight, prior)) / 2e-5 for d in np.eye(6) * 1e-5]
            assert np.allclose(slope, numeric, atol=1e-6)
    # Sums of parts add up to those of the whole.
    cut = rows < 30
    first = toxicity.sums(theta, rows[cut], cols[cut], positive[:30], weight[:30])
    second = toxicity.sums(theta, rows[~cut] - 30, cols[~cut], positive[30:], weight[30:])
    assert np.allclose(first + second, toxicity.sums(theta, rows, cols, positive, weight))


def test_fit_over_partitions(spark):
    r = np.random.default_rng(5)
    made = [(bool(i % 3 == 0), sorted(set(r.integers(0, 6, 3).tolist())), int(r.integers(1, 4))) for i in range(40)]
    sets, seen = settle(spark.createDataFrame(made, "positive boolean, words array<int>, n long").repartition(3), "sets")
    one = toxicity.fit_table(sets, seen.rows, 6, 0.3, 100, steps=4)
    parts = toxicity.fit_table(sets, seen.rows, 6, 0.3, 0, steps=4)
    assert np.allclose(one[0], parts[0]) and np.isclose(one[1], parts[1])


def test_telling_words(spark):
    """The features, by counts over all documents in plain Python."""
    texts = [prose(i, 30, 200) + (" vilest rotten" if i % 8 == 1 else "") + (" common" if i % 3 else "") for i in range(400)]
    marked = [(i, int(i % 8 == 1)) for i in range(400)]
    model = toxicity.train(documents(spark, texts), spark.createDataFrame(marked, "doc_id long, toxic int"))
    learnt = [(i, t) for i, t in marked if zlib.crc32(str(i).encode()) % 5]
    confirmed, prior = [i for i, t in learnt if t], sum(t for _, t in learnt) / len(learnt)

    def features(text):
        found = set()
        for w in re.findall(r"[^\x20\x09-\x0D!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]+", text.lower()):
            found |= {w, *(w[:n] for n in (4, 5, 6, 7, 8) if len(w) > n)}
        return found

    each = list(map(features, texts))
    p, u = Counter(f for i in confirmed for f in each[i]), Counter(f for x in each for f in x)
    chance = {f: len(confirmed) / 400 * (u[f] + 1) for f in p}
    telling = {f for f in p if p[f] >= 3 and p[f] >= 2 + chance[f] + 4 * math.sqrt(chance[f]) and prior * p[f] >= 0.5 * chance[f]}
    hashes = {f: int(toxicity.distinct_features(*as_bytes([f]))[0][0]) if len(f) <= 4 else None for f in telling}
    assert len(model.vocabulary) == len(telling) and {"vilest", "rotten"} <= telling and "common" not in telling
    assert {h for h in hashes.values() if h is not None} <= set(model.vocabulary.tolist())


def test_entry_point(tmp_path):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
    home = pathlib.Path(__spark_entry__.__file__).parent
    code = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), len(e.queries()) > 30)"
    for case, gone in enumerate((("llm", "corpus_pipeline.py"), ("llm",))):
        copy = shutil.copytree(home, tmp_path / str(case), ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", *gone))
        assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=copy).stdout.split() == ["[]", "True"]
    copy = shutil.copytree(home, tmp_path / "broken", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "katz.py"))
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=copy).returncode == 1


def test_column_functions_of_folds_are_native(spark):
    plan = spark.range(3).select(F.col("id").alias("doc_id")).select(labelled.fold(), katz.held_out())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
