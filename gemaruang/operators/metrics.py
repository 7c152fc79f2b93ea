"""Scoring predictions against labelled data.

Both sides are (id, aspect, vec): one vector for each id and aspect, prepared by ``gold_frame`` and ``prediction_frame``. Every metric is
an aggregation over a full outer join; the small tables that come out may be collected or written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gemaruang.functions import vectors as V

EPS = 2.220446049250313e-16


def labelled(df: DataFrame, aspect: str, vector: str, order: str, length: int = 3, normalize: bool = False) -> DataFrame:
    """(id, aspect, vec, ord): parsed rows; a vector of another length is an error, an unparsable one is null."""
    vec = V.require_length(V.parse_list(vector), length)
    return df.select("id", F.col(aspect).alias("aspect"), (V.normalize(vec) if normalize else vec).alias("vec"), F.col(order).alias("ord"))


def wrong_lengths(df: DataFrame, aspect: str, vector: str, order: str, length: int = 3) -> DataFrame:
    """(ord, id, aspect, entries): the rows that ``labelled`` refuses, whose lists parse but have another number of entries."""
    size = F.size(V.parse_list(vector))
    return df.select(F.col(order).alias("ord"), "id", F.col(aspect).alias("aspect"), size.alias("entries")).filter((F.col("entries") >= 0) & (F.col("entries") != length))


def last_vectors(rows: DataFrame) -> DataFrame:
    """(id, aspect, vec): the last parsed vector of each id and aspect."""
    return rows.filter(F.col("aspect").isNotNull() & F.col("vec").isNotNull()).groupBy("id", "aspect").agg(F.max_by("vec", "ord").alias("vec"))


def all_ids(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return gold.select("id").union(pred.select("id")).filter(F.col("id").isNotNull()).distinct()


def all_aspects(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(aspect) of both sides, those whose vectors did not parse included."""
    return gold.select("aspect").union(pred.select("aspect")).filter(F.col("aspect").isNotNull()).distinct()


def joined(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, aspect, g, p): full outer join of the last vectors."""
    g = last_vectors(gold).select("id", "aspect", F.col("vec").alias("g"))
    p = last_vectors(pred).select("id", "aspect", F.col("vec").alias("p"))
    return g.join(p, ["id", "aspect"], "full_outer")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def aspect_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(aspect, tp, fp, fn, tn) for every aspect of either side."""
    base = joined(gold, pred).groupBy("aspect").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    n = all_ids(gold, pred).agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    full = all_aspects(gold, pred).join(base, "aspect", "left").select("aspect", zero("tp").alias("tp"), zero("fp").alias("fp"), zero("fn").alias("fn"))
    return full.crossJoin(F.broadcast(n)).select("aspect", "tp", "fp", "fn", (F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def _scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)


def aspect_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(aspect, precision, recall, f1, support)."""
    p, r, f = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return aspect_counts(gold, pred).select("aspect", p.alias("precision"), r.alias("recall"), f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def aspect_summary(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: f1_macro and f1_micro."""
    c = aspect_counts(gold, pred)
    _, _, f = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    sums = c.agg(F.avg(f).alias("f1_macro"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    _, _, micro = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("f1_macro", micro.alias("f1_micro"))


def mismatches(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, gold, pred): aspects that only one side has, paired in order; what is left over is paired with ``none``."""
    sides = joined(gold, pred).groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("p").isNull(), F.col("aspect")))).alias("gs"), F.array_sort(F.collect_set(F.when(F.col("g").isNull(), F.col("aspect")))).alias("ps")
    )
    return sides.select("id", F.explode(F.arrays_zip("gs", "ps")).alias("z")).select("id", F.coalesce("z.gs", F.lit("none")).alias("gold"), F.coalesce("z.ps", F.lit("none")).alias("pred"))


def first_mismatches(gold: DataFrame, pred: DataFrame, n: int = 50) -> DataFrame:
    return mismatches(gold, pred).orderBy("id", "gold", "pred").limit(n)


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(gold, pred, n): aligned aspects with ``none``; combinations that do not occur are left out."""
    same = joined(gold, pred).filter(F.col("g").isNotNull() & F.col("p").isNotNull()).select(F.col("aspect").alias("gold"), F.col("aspect").alias("pred"))
    return same.unionByName(mismatches(gold, pred).select("gold", "pred")).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def exact_match(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: the share of ids whose sets of (aspect, class) are equal; two empty sets are."""
    j = joined(gold, pred)
    bad = j.filter(F.col("g").isNull() | F.col("p").isNull() | (V.argmax(F.col("g")) != V.argmax(F.col("p")))).select("id").distinct().withColumn("bad", F.lit(True))
    return all_ids(gold, pred).join(bad, "id", "left").agg(F.avg(F.when(F.col("bad"), 0.0).otherwise(1.0)).alias("exact_match_ratio"), F.count(F.lit(1)).alias("ids"))


def overlaps(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, aspect, g, p, t, q): normalised vectors of aspects both sides have, with their classes."""
    both = joined(gold, pred).filter(F.col("g").isNotNull() & F.col("p").isNotNull())
    return both.select("id", "aspect", V.normalize(F.col("g")).alias("g"), V.normalize(F.col("p")).alias("p"), V.argmax(F.col("g")).alias("t"), V.argmax(F.col("p")).alias("q"))


def sentiment_report(gold: DataFrame, pred: DataFrame, classes: int = 3) -> DataFrame:
    """(cls, precision, recall, f1, support) of each class."""
    o = overlaps(gold, pred)
    table = gold.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    hits = o.select(F.explode(F.array_distinct(F.array("t", "q"))).alias("cls"), "t", "q").groupBy("cls").agg(
        F.count_if((F.col("t") == F.col("cls")) & (F.col("q") == F.col("cls"))).alias("tp"), F.count_if((F.col("t") != F.col("cls")) & (F.col("q") == F.col("cls"))).alias("fp"), F.count_if((F.col("t") == F.col("cls")) & (F.col("q") != F.col("cls"))).alias("fn")
    )
    full = table.join(hits, "cls", "left").na.fill(0, ["tp", "fp", "fn"])
    p, r, f = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return full.select("cls", p.alias("precision"), r.alias("recall"), f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def sentiment_summary(gold: DataFrame, pred: DataFrame, classes: int = 3) -> DataFrame:
    """One row: macro, micro and weighted F1, accuracy, and the number of pairs."""
    r = sentiment_report(gold, pred, classes).agg(
        F.avg("f1").alias("macro_f1"), _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), F.sum("support").alias("pairs"), _ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy")
    )
    return r.select("macro_f1", F.col("accuracy").alias("micro_f1"), "weighted_f1", "accuracy", "pairs")


def sentiment_errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: mean squared error over all cells, log loss of the true class, and the number of pairs."""
    o = overlaps(gold, pred)
    square = F.aggregate(F.zip_with("g", "p", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    s = V.total(F.col("p"))
    true = F.get("p", V.argmax(F.col("g"))) / s
    loss = -F.log(F.greatest(F.least(true, F.lit(1 - EPS)), F.lit(EPS)))
    return o.agg((F.sum(square) / F.sum(F.size("g"))).alias("mse"), F.avg(loss).alias("log_loss"), F.count(F.lit(1)).alias("pairs"))


def _brier(rows: DataFrame) -> DataFrame:
    """(cls, brier, n) and their mean over classes that occur, from (g, p): squared error against the true class plus (R - 1) / R where the class is wrong."""
    t = V.argmax(F.col("g"))
    square = F.aggregate(F.transform("p", lambda x, i: F.pow(x - F.when(i == t, 1.0).otherwise(0.0), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    r = F.size("p")
    penalty = F.when(V.argmax(F.col("p")) != t, (r - 1) / r).otherwise(0.0)
    return rows.select(t.alias("cls"), (square + penalty).alias("b")).groupBy("cls").agg(F.avg("b").alias("brier"), F.count(F.lit(1)).alias("n"))


def brier(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(cls, brier, n) over the overlaps."""
    return _brier(overlaps(gold, pred))


def brier_baseline(gold: DataFrame, classes: int = 3) -> DataFrame:
    """(cls, brier, n) of always predicting the mean gold vector, over all gold rows; an unparsable vector counts as uniform."""
    g = gold.select(F.coalesce(V.normalize(F.col("vec")), F.array_repeat(F.lit(1.0 / classes), classes)).alias("g"))
    mean = g.agg(F.array(*[F.avg(F.get("g", F.lit(i))) for i in range(classes)]).alias("p"))
    return _brier(g.crossJoin(F.broadcast(mean)))


def brier_overall(per_class: DataFrame) -> DataFrame:
    return per_class.agg(F.avg("brier").alias("brier"))


def report_lines(gold: DataFrame, pred: DataFrame, sentiment: tuple[str, ...] = ("neg", "neu", "pos")) -> list[str]:
    """The evaluation report in fixed sections, from the small result tables."""
    out = ["=== Aspect category detection ==="]
    for r in aspect_scores(gold, pred).orderBy("aspect").collect():
        out.append(f"{r['aspect']}: precision {r['precision']:.4f}, recall {r['recall']:.4f}, f1 {r['f1']:.4f}, support {r['support']}")
    s = aspect_summary(gold, pred).first()
    out += [f"F1 macro {s['f1_macro'] or 0:.4f}", f"F1 micro {s['f1_micro'] or 0:.4f}", "", "=== Confusion of aspects (gold, predicted, rows) ==="]
    out += [f"{r['gold']} | {r['pred']} | {r['n']}" for r in confusion(gold, pred).orderBy("gold", "pred").collect()]
    out += ["", "=== Aspect against the rest (tn, fp, fn, tp) ==="]
    out += [f"{r['aspect']}: {r['tn']}, {r['fp']}, {r['fn']}, {r['tp']}" for r in aspect_counts(gold, pred).orderBy("aspect").collect()]
    e, m = sentiment_errors(gold, pred).first(), sentiment_summary(gold, pred, len(sentiment)).first()
    out += ["", "=== Sentiment ==="]
    if e["pairs"]:
        b, base = brier_overall(brier(gold, pred)).first()["brier"], brier_overall(brier_baseline(gold, len(sentiment))).first()["brier"]
        out += [f"MSE {e['mse']:.4f}", f"Log loss {e['log_loss']:.4f}", f"Penalised Brier {b:.4f}", f"Baseline Brier {base:.4f}", f"F1 macro {m['macro_f1']:.4f}, micro {m['micro_f1']:.4f}, weighted {m['weighted_f1']:.4f}"]
        out += [f"{sentiment[r['cls']]}: precision {r['precision']:.4f}, recall {r['recall']:.4f}, f1 {r['f1']:.4f}, support {r['support']}" for r in sentiment_report(gold, pred, len(sentiment)).orderBy("cls").collect()]
    else:
        out.append("no overlapping pairs")
    x = exact_match(gold, pred).first()
    out += ["", f"Exact match ratio {x['exact_match_ratio'] or 0:.4f} of {x['ids']} ids", "", "=== First mismatches ==="]
    return out + [f"{r['id']}: {r['gold']} -> {r['pred']}" for r in first_mismatches(gold, pred).collect()]
