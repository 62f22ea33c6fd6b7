"""Linear and threshold probes, hold-outs and classification metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.functions import vectors as vec
from featurelens.functions.hashing import seeded_key
from featurelens.functions.ranking import seeded_index, sorted_index
from featurelens.operators import balls
from featurelens.schemas import PROBE_COLUMNS
from featurelens.session import materialise

# Size of a packed ring of gallery centroids.
BLOCK_BYTES = 1024 * 1024


def source_holdout(
    df: DataFrame, seed: int = 0, subject: str = "subject_id", source: str = "source_video_id"
) -> DataFrame:
    """Held-out sources: per subject a seeded quarter, at least one.

    A subject with a single source is an error.
    """
    sources = df.select(subject, source).distinct()
    sizes = sources.groupBy(subject).agg(F.count(F.lit(1)).alias("_sources"))
    ranked = seeded_index(sources, [subject], seeded_key(seed, subject, source), [source], out="_slot")
    sized = ranked.join(sizes, subject)
    enough = F.when(
        F.col("_sources") < 2,
        F.raise_error(F.concat(F.lit("subject needs two sources: "), F.col(subject))),
    ).otherwise(F.greatest(F.lit(1), F.floor(F.col("_sources") / 4)))
    return sized.filter(F.col("_slot") < enough).select(subject, source)


def split_by_source(df: DataFrame, heldout: DataFrame, source: str = "source_video_id"):
    """``(train, validation)`` rows. A source held out for one subject is held out for all."""
    ids = heldout.select(source).distinct()
    return df.join(ids, source, "left_anti"), df.join(ids, source, "left_semi")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Class weight ``n / (classes * n_class)`` per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("examples"))
    total = counts.agg(F.sum("examples").alias("_n"), F.count(F.lit(1)).alias("_k"))
    one_row = F.broadcast(total)
    return counts.join(one_row).select(
        label, "examples", (F.col("_n") / (F.col("_k") * F.col("examples"))).alias("weight")
    )


def fit_probe(train: DataFrame, label: str, features: str = "features", max_iter: int = 2000, tolerance: float = 1e-6):
    """Standardised, class-balanced, L2-regularised logistic regression.

    Returns ``predict(df)`` which adds ``prediction`` (a label) and ``probability``.
    Scaling uses the training mean and population spread; a constant dimension is
    scaled by one. The penalty weight matches an inverse strength of one over the sum
    of the losses.
    """
    # Class counts, scaling and the solver all read the training rows.
    train = train.select(label, features).persist()
    weights = sorted_index(balanced_weights(train, label), [], [F.col(label)], out="_index")
    classes = materialise(
        weights.select(
            F.col(label).alias("_label"),
            F.col("_index").cast("double").alias("_index"),
            F.col("weight").alias("_weight"),
            "examples",
        )
    )
    n, k = classes.agg(F.coalesce(F.sum("examples"), F.lit(0)), F.count(F.lit(1))).first()
    if k < 2:
        raise ValueError("a probe needs at least two classes")
    stats = train.agg(vec.means(features).alias("mean"), vec.deviations(features).alias("std")).first()
    mean, std = list(stats["mean"]), [s if s > 0 else 1.0 for s in stats["std"]]
    shift, scale = vec.literal(mean), vec.literal(std)

    def scaled(df):
        centred = vec.minus(vec.as_doubles(features), shift)
        return df.withColumn(
            "_scaled", array_to_vector(F.zip_with(centred, scale, lambda x, s: x / s))
        )

    indexed = scaled(train).join(classes, F.col(label) == F.col("_label"))
    solver = LogisticRegression(
        featuresCol="_scaled",
        labelCol="_index",
        weightCol="_weight",
        regParam=1.0 / n,
        standardization=False,
        maxIter=max_iter,
        tol=tolerance,
        predictionCol="_class",
        probabilityCol="_probability",
        rawPredictionCol="_raw",
    )
    model = solver.fit(indexed.select("_scaled", "_index", "_weight"))
    train.unpersist()
    names = classes.select(F.col("_index").alias("_class"), F.col("_label").alias("prediction"))

    def predict(df: DataFrame) -> DataFrame:
        scored = model.transform(scaled(df)).join(names, "_class")
        return scored.withColumn("probability", vector_to_array("_probability")).drop(
            "_class", "_raw", "_probability", "_scaled"
        )

    predict.model = model
    predict.classes = classes
    return predict


def classification_metrics(
    predictions: DataFrame,
    label: str,
    task: str,
    train_examples: int | DataFrame,
    model: str = "trained",
    prediction: str = "prediction",
) -> DataFrame:
    """One row of scores from a confusion table.

    Classes and the majority share come from the true labels only; balanced accuracy
    is the mean recall over them; macro F1 averages over true and predicted labels.
    """
    pairs = predictions.groupBy(
        F.col(label).cast("string").alias("truth"), F.col(prediction).cast("string").alias("guess")
    ).agg(F.count(F.lit(1)).alias("n"))
    # A cell of the confusion table counts once for its true and once for its guessed class.
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("truth").alias("name"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("guessed"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("guess").alias("name"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hit")),
            )
        )
    )
    by_class = sides.groupBy("name").agg(
        F.sum("true").alias("true"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit")
    )
    present = F.col("true") > 0
    f1 = 2 * F.col("hit") / (F.col("true") + F.col("guessed"))
    row = by_class.agg(
        F.sum("true").alias("val_examples"),
        F.count(F.when(present, 1)).alias("num_classes"),
        (F.max("true") / F.sum("true")).alias("majority_baseline"),
        (F.sum("hit") / F.sum("true")).alias("accuracy"),
        F.avg(F.when(present, F.col("hit") / F.col("true"))).alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1"),
    )
    if isinstance(train_examples, DataFrame):
        row = row.join(F.broadcast(train_examples.agg(F.count(F.lit(1)).alias("train_examples"))))
    else:
        row = row.withColumn("train_examples", F.lit(train_examples).cast("bigint"))
    return row.withColumn("model", F.lit(model)).withColumn("task", F.lit(task)).select(*PROBE_COLUMNS)


def probe_condition(
    table: DataFrame, label: str = "gait_system", task: str | None = None, model: str = "trained"
) -> DataFrame:
    """Fit on split ``train``, score on split ``test``."""
    train, test = table.filter("split = 'train'"), table.filter("split = 'test'")
    return classification_metrics(
        fit_probe(train, label)(test), label, task or label, train, model
    )


def probe_identity(
    table: DataFrame, seed: int = 0, split: str = "train", model: str = "trained"
) -> DataFrame:
    """Identify subjects of one split with whole sources held out."""
    rows = table.filter(F.col("split") == split)
    train, held = split_by_source(rows, source_holdout(rows, seed))
    return classification_metrics(
        fit_probe(train, "subject_id")(held), "subject_id", "identity", train, model
    )


def default_probes(seed: int = 0) -> list[Callable[[DataFrame, str], DataFrame]]:
    return [
        lambda table, model: probe_condition(table, model=model),
        lambda table, model: probe_identity(table, seed, model=model),
    ]


def run_probes(tables: dict[str, DataFrame], probes=None) -> DataFrame:
    """Every probe on every named feature table, one row each."""
    rows = None
    for model, table in tables.items():
        for probe in probes or default_probes():
            row = probe(table, model)
            rows = row if rows is None else rows.unionByName(row)
    return rows


def exposure_ledger(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Scores beside the rows, recordings, subjects and labels they rest on."""
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return predictions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("recording_id").alias("recordings"),
        F.countDistinct("subject_id").alias("subjects"),
        F.countDistinct(label).alias("labels"),
        F.countDistinct(prediction).alias("predicted_labels"),
        F.avg(hit).alias("accuracy"),
    )


def vote(predictions: DataFrame, keys: list[str], prediction: str = "prediction") -> DataFrame:
    """Majority prediction of each unit; ties go to the smallest label."""
    votes = predictions.groupBy(*keys, prediction).agg(F.count(F.lit(1)).alias("_votes"))
    best = F.min(F.struct((-F.col("_votes")).alias("n"), F.col(prediction).alias("p")))
    return votes.groupBy(*keys).agg(best.alias("_b"), F.sum("_votes").alias("windows")).select(
        *keys, F.col("_b.p").alias(prediction), "windows"
    )


def roll_up(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Window predictions -> recording votes -> subject accuracy."""
    recordings = vote(predictions, ["subject_id", "recording_id", label], prediction)
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return recordings.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("recordings"),
        F.sum("windows").alias("windows"),
        F.avg(hit).alias("accuracy"),
    )


def threshold_probe(train: DataFrame, value: str, label: str, low: str, high: str) -> DataFrame:
    """Best single cut: ``low`` below it, ``high`` from it upward, fitted on ``train``.

    Candidate cuts are the midpoints between neighbouring distinct values (and one end
    beyond each). Values are counted before they are ordered; ties go to the lowest cut.
    Rows without a value (null or NaN) take no part, and none is predicted for them.
    """
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = train.filter(F.col(label).isin(low, high) & known).groupBy(value).agg(
        F.sum((F.col(label) == low).cast("bigint")).alias("lows"),
        F.sum((F.col(label) == high).cast("bigint")).alias("highs"),
    )
    counts = materialise(counts)
    totals = F.broadcast(counts.agg(F.sum("lows").alias("_lows"), F.sum("highs").alias("_highs")))
    running = {"_lows_below": F.col("lows"), "_highs_below": F.col("highs"), "_i": F.lit(1)}
    ranked = sorted_index(counts, [], [F.col(value)], weights=running)
    # The previous distinct value arrives by an equi-join on the position.
    earlier = ranked.select((F.col("_i") + 1).alias("_i"), F.col(value).alias("_earlier"))
    cuts = ranked.join(earlier, "_i", "left").join(totals)
    below = cuts.select(
        F.coalesce((F.col("_earlier") + F.col(value)) / 2, F.col(value)).alias("cut"),
        (F.col("_lows_below") + F.col("_highs") - F.col("_highs_below")).alias("correct"),
        (F.col("_lows") + F.col("_highs")).alias("examples"),
    )
    beyond = counts.agg(
        (F.max(value) + 1).alias("cut"),
        F.sum("lows").alias("correct"),
        (F.sum("lows") + F.sum("highs")).alias("examples"),
    )
    best = F.min(F.struct((-F.col("correct")).alias("c"), "cut", "examples"))
    chosen = below.unionByName(beyond).agg(best.alias("b"))
    return chosen.select(
        F.col("b.cut").alias("cut"),
        (-F.col("b.c")).alias("correct"),
        (-F.col("b.c") / F.col("b.examples")).alias("train_accuracy"),
    )


def apply_threshold(df: DataFrame, cut: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Predictions of a fitted cut (one row, so the broadcast is one row)."""
    placed = df.join(F.broadcast(cut.select(F.col("cut").alias("_cut"))))
    return placed.withColumn(
        "prediction",
        F.when(F.col(value).isNull() | F.isnan(F.col(value).cast("double")), None)
        .when(F.col(value) < F.col("_cut"), low)
        .otherwise(high),
    ).drop("_cut")


def matched_subset(
    df: DataFrame, value: str, label: str, classes: list[str], id_column: str, bin_width: float, seed: int = 0
) -> DataFrame:
    """Equal seeded counts of every class inside each bin of ``value``."""
    binned = df.filter(F.col(label).isin(classes)).withColumn(
        "bin", F.floor(F.col(value) / F.lit(bin_width))
    )
    sizes = binned.groupBy("bin").agg(
        F.least(
            *[F.count(F.when(F.col(label) == c, 1)) for c in classes]
        ).alias("_keep")
    )
    key = seeded_key(seed, id_column)
    ranked = seeded_index(binned, ["bin", label], key, [id_column], out="_slot")
    return ranked.join(sizes.filter("_keep > 0"), "bin").filter(
        F.col("_slot") < F.col("_keep")
    ).drop("_slot", "_keep")


def nearest_centroid(
    queries: DataFrame, gallery: DataFrame, identity: str, key: str, metric: str = "cosine"
) -> DataFrame:
    """Closest gallery identity per query, with the rank of the true one.

    Gallery vectors are averaged per identity; ``metric`` is ``cosine`` or ``euclidean``
    (centroids are scaled to unit length for the former). Centroids lie in rings around
    pivots, and a query visits only rings that can hold its best match or that its own score
    cuts through (see ``balls``); rings ahead as a whole count by their size. Ties,
    to twelve decimals, go to the smallest name. A zero vector has no direction: under
    ``cosine`` a zero centroid is never a match, and a zero query has neither match nor rank.
    """
    centroids = gallery.groupBy(F.col(identity).alias("name")).agg(
        vec.means("features").alias("centre")
    )
    if metric == "cosine":
        length = vec.norm("centre")
        centroids = centroids.withColumn("_length", length).filter("_length > 0").select(
            "name", vec.divided("centre", F.col("_length")).alias("centre")
        )
    centroids = materialise(centroids)

    own = centroids.select(F.col("name").alias(identity), F.col("centre").alias("_own"))
    asked = queries.select(key, identity, vec.as_doubles("features").alias("features"))
    score = F.round(_closeness(metric)(F.col("features"), F.col("_own")), 12)
    if metric == "cosine":
        score = F.when(vec.squared_norm("features") > 0, score)
    asked = asked.join(own, identity, "left").select(key, identity, score.alias("_score"), "features")

    kinds = {c: asked.schema[c].dataType.simpleString() for c in (key, identity)}
    ringed = balls.rings(centroids, metric == "cosine", BLOCK_BYTES)
    if ringed is None:
        return asked.limit(0).select(
            key, identity, F.lit(None).cast(kinds[identity]).alias("prediction"), F.lit(None).cast("bigint").alias("true_rank")
        )
    numbered, listed = ringed
    visits = asked.mapInArrow(
        balls.routed(listed),
        f"_block long, _keys array<{kinds[key]}>, _ids array<{kinds[identity]}>, _scores array<double>,"
        " _base array<bigint>, _x binary",
    )
    packs = (
        numbered.repartition("_block")
        .sortWithinPartitions("_block", "name")
        .mapInArrow(balls.packed, f"_block long, _names array<{kinds[identity]}>, _c binary")
    )
    found = visits.join(packs, "_block").select("_keys", "_ids", "_scores", "_base", "_x", "_names", "_c").mapInArrow(
        _match(metric),
        f"_key {kinds[key]}, _id {kinds[identity]}, s double, name {kinds[identity]}, ahead bigint, base bigint",
    )
    merged = found.groupBy(F.col("_key").alias(key), F.col("_id").alias(identity)).agg(
        F.min(F.when(F.col("name").isNotNull(), F.struct(-F.col("s"), F.col("name")))).alias("top"),
        F.sum("ahead").alias("ahead"),
        F.max("base").alias("base"),
    )
    return merged.select(
        key,
        identity,
        F.col("top.name").alias("prediction"),
        (F.col("ahead") + F.col("base") + 1).cast("bigint").alias("true_rank"),
    )


def _closeness(metric: str):
    if metric == "cosine":
        return vec.dot
    return lambda a, b: -vec.squared_norm(vec.minus(a, b))


def _match(metric: str):
    def matched(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, ids, scores, base, x, names, c = (column[i] for column in batch.columns)
                ids_list, names_list = ids.as_py(), names.as_py()
                left = np.frombuffer(x.as_py()).reshape(len(ids_list), -1)
                right = np.frombuffer(c.as_py()).reshape(len(names_list), -1)
                close = left @ right.T
                if metric != "cosine":
                    close = 2 * close - (left**2).sum(axis=1)[:, None] - (right**2).sum(axis=1)
                close = np.round(close, 12)
                true = np.array([np.nan if s is None else s for s in scores.as_py()], float)
                # Names ascend, so the first of equal values is the smallest name.
                best = close.argmax(axis=1)
                place = {name: j for j, name in enumerate(names_list)}
                own = np.array([place.get(name, -1) for name in ids_list])
                above = close > true[:, None]
                above[np.flatnonzero(own >= 0), own[own >= 0]] = False
                blank = (metric == "cosine") & ~left.any(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.values,
                        ids.values,
                        pa.array(close[np.arange(len(best)), best], mask=blank),
                        pa.array([None if blank[r] else names_list[j] for r, j in enumerate(best)], names.values.type),
                        pa.array(above.sum(axis=1), pa.int64(), mask=np.isnan(true)),
                        base.values,
                    ],
                    names=["_key", "_id", "s", "name", "ahead", "base"],
                )

    return matched


def heldout_retrieval(
    df: DataFrame, seed: int = 0, subject: str = "subject_id", recording: str = "recording_id", key: str = "vec_id"
) -> DataFrame:
    """Top-1 retrieval with one seeded gallery recording per subject.

    Queries are all rows of the subject's other recordings.
    """
    recordings = df.select(subject, recording).distinct()
    pick = F.min_by(recording, F.struct(seeded_key(seed, recording), F.col(recording)))
    chosen = recordings.groupBy(subject).agg(pick.alias(recording))
    gallery = df.join(chosen, [subject, recording], "left_semi")
    queries = df.join(chosen, [subject, recording], "left_anti")
    return nearest_centroid(queries, gallery, subject, key)


def retrieval_score(matches: DataFrame, identity: str, identities: int) -> DataFrame:
    hit = (F.col(identity) == F.col("prediction")).cast("double")
    return matches.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(hit).alias("top1"),
        F.avg("true_rank").alias("mean_rank"),
    ).withColumn("chance", F.lit(1.0 / identities))


def position_baseline(train: DataFrame, test: DataFrame, position: list[str], label: str) -> DataFrame:
    """Predict each position's commonest training label; unseen positions the overall one."""
    votes = train.groupBy(*position, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("l")))
    modes = votes.groupBy(*position).agg(best["l"].alias("_mode"))
    overall = (
        votes.groupBy(label).agg(F.sum("_n").alias("_n")).agg(best["l"].alias("_overall"))
    )
    placed = test.join(modes, position, "left").join(F.broadcast(overall))
    return placed.withColumn("prediction", F.coalesce("_mode", "_overall")).drop("_mode", "_overall")


def accuracy_gain(predictions: DataFrame, label: str, baseline: str, probe: str) -> DataFrame:
    """Accuracy of a probe, of its baseline and the gain between them."""
    def share(column):
        return F.avg((F.col(label) == F.col(column)).cast("double"))

    return predictions.agg(
        share(baseline).alias("baseline_accuracy"), share(probe).alias("probe_accuracy")
    ).withColumn("gain", F.col("probe_accuracy") - F.col("baseline_accuracy"))


def top_k_scores(scored: DataFrame, label: str, ks=(1, 5)) -> DataFrame:
    """Top-k and macro accuracy from ``ranking``, labels in falling probability."""
    hits = [F.array_contains(F.slice("ranking", 1, k), F.col(label)).cast("double") for k in ks]
    per_class = scored.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(h).alias(f"_h{k}") for h, k in zip(hits, ks)],
    )
    return per_class.agg(
        F.sum("_n").alias("examples"),
        *[(F.sum(f"_h{k}") / F.sum("_n")).alias(f"top{k}") for k in ks],
        F.avg(F.col(f"_h{ks[0]}") / F.col("_n")).alias("macro_accuracy"),
    )


def pair_accuracy(scored: DataFrame, label: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Accuracy inside declared class pairs: which of the two labels ranks higher.

    Each row carries only the pairs of its own label, from a constant list.
    """
    listed = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]
    )
    own = F.filter(listed, lambda p: (p["a"] == F.col(label)) | (p["b"] == F.col(label)))
    rows = scored.withColumn("_pair", F.explode(own))
    other = F.when(F.col("_pair.a") == F.col(label), F.col("_pair.b")).otherwise(F.col("_pair.a"))
    ahead = F.array_position("ranking", F.col(label)) < F.array_position("ranking", other)
    return rows.groupBy(
        F.col("_pair.a").alias("first_label"), F.col("_pair.b").alias("second_label")
    ).agg(F.count(F.lit(1)).alias("examples"), F.avg(ahead.cast("double")).alias("accuracy"))


def information_gain(
    train: DataFrame, test: DataFrame, label: str, metadata: str, features: str
) -> DataFrame:
    """What features add to metadata: accuracy and mean log-loss of both probes."""
    joined = F.concat(vec.as_doubles(metadata), vec.as_doubles(features))

    def scores(name, column):
        fitted = fit_probe(train.withColumn("features", column), label)
        place = fitted.classes.select(F.col("_label").alias(label), F.col("_index").cast("int").alias("_place"))
        rows = fitted(test.withColumn("features", column)).join(place, label, "left")
        p = F.get(F.col("probability"), F.col("_place"))
        return rows.agg(
            F.avg((F.col(label) == F.col("prediction")).cast("double")).alias(f"{name}_accuracy"),
            F.avg(-F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(1e-15)))).alias(f"{name}_log_loss"),
        )

    base = scores("metadata", vec.as_doubles(metadata))
    both = scores("combined", joined)
    out = base.join(F.broadcast(both))
    return out.withColumn(
        "accuracy_gain", F.col("combined_accuracy") - F.col("metadata_accuracy")
    ).withColumn("information_gain", F.col("metadata_log_loss") - F.col("combined_log_loss"))


def best_checkpoint(history: DataFrame, run: str = "run_id", loss: str = "loss") -> DataFrame:
    """Per run the earliest strict minimum of the tuning loss, and the last epoch."""
    real = F.col(loss).isNotNull() & ~F.isnan(loss)
    order = F.when(real, F.struct(F.col(loss).alias("l"), F.col("epoch").alias("e")))
    return history.groupBy(run).agg(
        F.min(order)["e"].alias("best_epoch"),
        F.min(order)["l"].alias("best_loss"),
        F.max("epoch").alias("last_epoch"),
    )


def selection_regret(runs: DataFrame, metric: str, transfer: str, run: str = "run_id", ks=(1, 10)) -> DataFrame:
    """Transfer lost by taking the best of the metric's top k instead of the oracle's best."""
    ranked = sorted_index(runs, [], [F.col(metric).desc(), F.col(run)], out="_place")
    tops = [F.max(F.when(F.col("_place") < k, F.col(transfer))) for k in ks]
    return ranked.agg(
        F.max(transfer).alias("oracle"),
        *[(F.max(transfer) - top).alias(f"regret_top{k}") for top, k in zip(tops, ks)],
    )
