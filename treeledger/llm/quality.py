"""Quality: a document classifier whose evidence is combined with what is known of its host and path.

The classifier is a logistic model on the make-up of a text. Hosts and paths (parts of a host) have
a share of good documents that follows a beta distribution: the labelled documents are counted per
path and per host, the spread of the hosts' shares gives the strength of the global prior, the
spread of the paths' shares within their hosts that of the host's prior. So a path without labels has the
share of its host, a host without labels the global one, and both move away from it only as far as
their own counts carry. The log odds of the classifier are shifted by the path's posterior against
the global share. A labelled document never counts in its own prior.

Nulls: a missing text is empty, a missing host or path is a host or path of its own. Labels that are
null are not counted. Without labels of both kinds every score is the global prior of one half.
Repeated rows are scored each by itself. All other columns pass through. Empty tables give empty
results.
"""

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.shared import free_name, keyed_join, prepare, stored, texts, with_column_from_text
from treeledger.llm.toxicity import HELD_OUT, fit_logistic, training_rows

N_FEATURES = 14
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_MARKS = b"#$%&*|~^=<>{}[]\\/_+@"
_SHOUT = b"!?"
_STOP = b".,;:"
# Prior strength, in documents, that the moments may give.
_STRENGTH = (2.0, 1000.0)
# Clip of the classifier's log odds, so that one text's evidence stays finite.
MOST_EVIDENCE = 12.0


def make_up(text: bytes) -> list[float]:
    """What the classifier sees of a text: lengths, repetition, and shares of kinds of characters."""
    words = text.split()
    size, count = max(1, len(text)), max(1, len(words))
    kinds = Counter(words)
    share = lambda chars: 1 - len(text.translate(None, chars)) / size
    repeated = sum(map(bytes.__eq__, words, words[1:])) / count
    top = max(kinds.values(), default=0) / count
    distinct = len(kinds) / count
    lines = [line for line in text.split(b"\n") if line]
    upper, marks, shout = share(_UPPER), share(_MARKS), share(_SHOUT)
    return [
        np.log1p(len(words)),
        len(b"".join(words)) / count / 10,
        distinct,
        distinct * np.log1p(len(words)) / 8,
        top,
        repeated,
        np.sqrt(repeated),
        upper * 4,
        np.sqrt(upper),
        marks * 10,
        np.sqrt(marks),
        np.sqrt(shout),
        np.sqrt(share(_DIGIT)) + np.sqrt(share(_STOP)),
        len(set(lines)) / max(1, len(lines)),
    ]


class QualityModel(NamedTuple):
    weights: list[float] | None  # of the make-up, and the constant
    center: list[float]
    scale: list[float]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[float(x) for x in make_up(text)] for text in texts(batch.column(0))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(1).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["label", "features"]
        )


def fit(docs: DataFrame, labels: DataFrame, held_out: bool = False) -> QualityModel:
    """Learn the classifier from a bounded number of labelled rows (``TRAINING_ROWS`` of toxicity)."""
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, "quality", held_out).mapInArrow(_features, "label int, features array<double>")
    found = rows.toPandas()
    label = found["label"].to_numpy(float)
    if not len(found) or label.min() == label.max():
        return QualityModel(None, [], [])
    x = np.array(found["features"].tolist())
    center, scale = x.mean(0), x.std(0) + 1e-6
    weights = fit_logistic((x - center) / scale, label)
    return QualityModel(weights.tolist(), center.tolist(), scale.tolist())


def evidence(docs: DataFrame, model: QualityModel, name: str) -> DataFrame:
    """All columns and the classifier's log odds that a text is good."""
    if model.weights is None:
        return docs.withColumn(name, F.lit(0.0))
    prepare(docs.sparkSession)

    def values(found: list[bytes]) -> pa.Array:
        if not found:
            return pa.array([], pa.float64())
        x = (np.array([make_up(text) for text in found]) - model.center) / model.scale
        odds = x @ np.array(model.weights[:-1]) + model.weights[-1]
        return pa.array(np.clip(odds, -MOST_EVIDENCE, MOST_EVIDENCE), pa.float64())

    return with_column_from_text(docs, name, "double", values)


def site_posteriors(counts: DataFrame) -> tuple[DataFrame, float]:
    """For each host and path its posterior share of good documents as two beta parameters.

    ``counts`` has host, path, n and good, a row per path. Prior strengths come from moments over
    all hosts and paths, in one aggregate each; the driver gets those few sums only.
    """
    total = counts.agg(F.expr("coalesce(sum(n), 0)"), F.expr("coalesce(sum(good), 0)")).first()
    share = (float(total[1]) + 1) / (float(total[0]) + 2)
    hosts = counts.groupBy("host").agg(F.expr("sum(n) AS host_n"), F.expr("sum(good) AS host_good"))

    def strength(groups: DataFrame, n: str, good: str, mean: str) -> float:
        # The excess of squared deviations over that of one common share, as in a beta-binomial model.
        row = groups.where(f"{n} > 1").agg(
            F.expr(f"sum(power({good} - {n} * {mean}, 2))"),
            F.expr(f"sum({n} * {mean} * (1 - {mean}))"),
            F.expr(f"sum({n} * ({n} - 1.0D) * {mean} * (1 - {mean}))"),
        ).first()
        if not row[2]:
            return _STRENGTH[1]
        alike = max(0.0, (float(row[0]) - float(row[1])) / float(row[2]))
        return float(np.clip((1 - alike) / alike if alike > 1e-9 else _STRENGTH[1], *_STRENGTH))

    of_host = strength(hosts, "host_n", "host_good", f"{share}D")
    hosts = hosts.selectExpr(
        "host", "host_n", "host_good", f"(host_good + {of_host}D * {share}D) / (host_n + {of_host}D) AS host_share"
    )
    both = stored(counts.join(hosts, counts["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]), "paths")
    of_path = strength(both, "n", "good", "host_share")
    posteriors = both.selectExpr(
        "host", "path", f"good + {of_path}D * host_share AS alpha", f"n - good + {of_path}D * (1 - host_share) AS beta"
    )
    return posteriors, share


def score(
    docs: DataFrame,
    labels: DataFrame,
    model: QualityModel,
    host: str = "source",
    path: str = "lang",
    name: str | None = None,
    held_out: bool = False,
) -> DataFrame:
    """All columns of the documents and the chance that the document is good.

    The counts per path are a stored table, broadcast if small, else joined by shuffle. A host
    without any counted path takes the global share.
    """
    spark = docs.sparkSession
    prepare(spark)
    usable = labels.selectExpr("CAST(doc_id AS LONG) AS _id", "CAST(quality AS DOUBLE) AS _good").where("_good IN (0, 1)")
    if held_out:
        usable = usable.where(f"NOT {HELD_OUT.replace('doc_id', '_id')}")
    usable = stored(usable.groupBy("_id").agg(F.expr("max(_good) AS _good")), "quality-labels")
    sites = docs.selectExpr("CAST(doc_id AS LONG) AS _id", f"CAST({host} AS STRING) AS host", f"CAST({path} AS STRING) AS path")
    counts = stored(
        keyed_join(sites, usable, ["_id"]).groupBy("host", "path").agg(F.expr("count(1) AS n"), F.expr("sum(_good) AS good")),
        "site-counts",
    )
    posteriors, share = site_posteriors(counts)
    by_host = posteriors.groupBy("host").agg(F.expr("sum(alpha) AS alpha"), F.expr("sum(beta) AS beta"))
    # A row with the path's beta parameters, or else the host's, under a key without nulls.
    keyed = posteriors.selectExpr("concat('p', to_json(struct(host, path), map('ignoreNullFields', 'false'))) AS _site", "alpha AS _alpha", "beta AS _beta")
    keyed = stored(
        keyed.union(by_host.selectExpr("concat('h', to_json(struct(host), map('ignoreNullFields', 'false'))) AS _site", "alpha AS _alpha", "beta AS _beta")),
        "sites",
    )
    taken = docs.columns
    odds = free_name(docs, "_odds")
    scored = evidence(docs, model, odds).select(
        F.struct(*[F.col(f"`{c}`") for c in taken]).alias("_doc"),
        F.col(odds).alias("_odds"),
        F.expr("CAST(doc_id AS LONG) AS _id"),
        F.expr(f"concat('p', to_json(struct(CAST({host} AS STRING) AS host, CAST({path} AS STRING) AS path), map('ignoreNullFields', 'false'))) AS _site"),
        F.expr(f"concat('h', to_json(struct(CAST({host} AS STRING) AS host), map('ignoreNullFields', 'false'))) AS _host"),
    )
    found = keyed_join(scored, keyed, ["_site"], "left")
    found = keyed_join(found, keyed.selectExpr("_site AS _host", "_alpha AS _host_alpha", "_beta AS _host_beta"), ["_host"], "left")
    found = keyed_join(found, usable.withColumnRenamed("_good", "_own"), ["_id"], "left")
    # Without the document's own label.
    alpha = "coalesce(_alpha - coalesce(_own, 0), _host_alpha)"
    beta = "coalesce(_beta - coalesce(1 - _own, 0), _host_beta)"
    prior = f"coalesce(ln(({alpha} + 1e-3D) / ({beta} + 1e-3D)) - ln({share}D / (1 - {share}D)), 0)"
    chance = "0.5D" if model.weights is None else f"1 / (1 + exp(-(_odds + {prior})))"
    return found.selectExpr("_doc.*", f"{chance} AS `{name or free_name(docs, 'score')}`")
