"""Dashboard analytics as DataFrames.

Distinct-genome counts group by (label, dataset_id) first -- a partial
aggregate per task -- so a label holding a third of all rows never reaches a
single task as raw rows.  Genome-level work runs on ``genome_statistics``,
which has one row per genome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import (ENVIRONMENT_COLUMNS, PHYLO_COLUMNS, RANK_PREFIX, clean_label,
                                  rank_raw)
from ..schemas import CLASSIFIER_PREFIX
from .common import top


def _is(kind: str) -> Column:
    return F.col("seq_type") == kind


def _records(weight: str | None) -> Column:
    """Number of records: of rows, or the sum of ``weight`` where a row stands for many records."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def per_genome(df: DataFrame, cols, with_rows: bool = False, weight: str | None = None) -> DataFrame:
    """One row per genome carrying genome-level columns (constant per genome in
    the catalogue contract) and optionally its record count.

    A partial aggregate keyed by dataset_id: label parsing, explodes and
    distinct counts then run over genomes instead of records (thousands of
    rows instead of billions), and a genome holding a third of all records is
    reduced map-side.
    """
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in cols]
    if with_rows:
        aggs.append(_records(weight).alias("_rows"))
    return df.groupBy("dataset_id").agg(*aggs)


def _genomes_per_label(genomes: DataFrame, label: Column, n: int | None, with_rows: bool = False) -> DataFrame:
    extra = [F.sum("_rows").alias("sequences")] if with_rows else []
    g = genomes.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("genomes"), *extra)
    return top(g, n, F.col("genomes").desc(), F.col("label"))


def taxonomy_distribution(seqs: DataFrame, level: str, source: str = "classifier",
                          n: int | None = 25, anchored: bool = True) -> DataFrame:
    """Distinct genomes per rank label of nucleotide records.

    ``classifier``: label parsed from ``taxonomy_majority`` ('' and 'NA' ->
    Unassigned); ``phylo``: the metadata rank column ('' -> Unassigned).
    """
    nt = seqs.filter(_is("NT"))
    if source in ("classifier", CLASSIFIER_PREFIX.rstrip("_")):
        g = per_genome(nt, ["taxonomy_majority"])
        label = clean_label(rank_raw(F.col("taxonomy_majority"), level, anchored), na_is_missing=True)
    elif source == "phylo":
        column = PHYLO_COLUMNS.get(level)
        if column is None:
            raise ValueError(f"Unsupported taxonomy level: {level}")
        g = per_genome(nt, [column])
        label = clean_label(F.col(column), na_is_missing=False)
    else:
        raise ValueError(f"Unsupported taxonomy source: {source}")
    return _genomes_per_label(g, label, n)


def taxonomy_all_levels(seqs: DataFrame, anchored: bool = True) -> DataFrame:
    """Every classifier level and every phylo level in ONE scan.

    Records are reduced to genome rows first; each genome is then projected
    to a (source, level, label) triple per level -- no per-level rescans and
    unions, and no per-record explode.
    """
    nt = per_genome(seqs.filter(_is("NT")), ["taxonomy_majority", *PHYLO_COLUMNS.values()])
    triples = [F.struct(F.lit("classifier").alias("source"), F.lit(lv).alias("level"),
                        clean_label(rank_raw(F.col("taxonomy_majority"), lv, anchored)).alias("label"))
               for lv in RANK_PREFIX]
    triples += [F.struct(F.lit("phylo").alias("source"), F.lit(lv).alias("level"),
                         clean_label(F.col(col), na_is_missing=False).alias("label"))
                for lv, col in PHYLO_COLUMNS.items()]
    long = nt.select("dataset_id", F.explode(F.array(*triples)).alias("t")).select("dataset_id", "t.*")
    return long.groupBy("source", "level", "label").agg(F.count(F.lit(1)).alias("genomes"))


def environment_distribution(seqs: DataFrame, dimension: str, n: int | None = 30) -> DataFrame:
    """A10: distinct genomes and records per environment label (all record types)."""
    if dimension not in ENVIRONMENT_COLUMNS:
        raise ValueError(f"Unsupported environment dimension: {dimension}")
    label = clean_label(F.col(dimension), na_is_missing=False)
    return _genomes_per_label(per_genome(seqs, [dimension], with_rows=True), label, n, with_rows=True)


def environment_all_dimensions(seqs: DataFrame, weight: str | None = None) -> DataFrame:
    """U2 for environments: all six dimensions in one scan (long format)."""
    g = per_genome(seqs, list(ENVIRONMENT_COLUMNS), with_rows=True, weight=weight)
    pairs = [F.struct(F.lit(d).alias("dimension"), clean_label(F.col(d), na_is_missing=False).alias("label"))
             for d in ENVIRONMENT_COLUMNS]
    long = g.select("_rows", F.explode(F.array(*pairs)).alias("p")).select("_rows", "p.*")
    return long.groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("genomes"),
                                                  F.sum("_rows").alias("sequences"))


def genome_statistics(seqs: DataFrame, metadata: DataFrame | None = None,
                      anchored: bool = False) -> DataFrame:
    """One row per genome with parsed ranks (+ J6 completeness override).

    Ranks use the pandas ``str.extract`` semantics of the reference: no match
    or null -> Unassigned, a literal 'NA' label is kept.
    """
    g = (seqs.filter(_is("NT")).groupBy("dataset_id").agg(
        F.max("lenbp").alias("genome_length"),
        F.max("genecount").alias("gene_count"),
        F.avg("gcperc").alias("gc_percent"),
        F.avg("codingperc").alias("coding_percent"),
        F.max("contigs").alias("contig_count"),
        F.max("order_completeness").alias("completeness"),
        F.max("order_dup").alias("contamination"),
        F.max("taxonomy_majority").alias("taxonomy_majority"),
        F.max("ecosystem").alias("ecosystem"),
    ))
    if metadata is not None:
        g = override_completeness(g, metadata)
    ranks = {f"taxonomy_{lv}": clean_label(rank_raw(F.col("taxonomy_majority"), lv, anchored),
                                           na_is_missing=False)
             for lv in RANK_PREFIX}
    return (g.withColumns(ranks)
            .withColumn("genome_length_mb", F.col("genome_length") / F.lit(1e6))
            .withColumn("completeness", F.coalesce(F.col("completeness").cast("double"), F.lit(0.0)))
            .withColumn("contamination", F.coalesce(F.col("contamination").cast("double"), F.lit(0.0)))
            .withColumn("contig_count", F.coalesce(F.col("contig_count"), F.lit(0)).cast("long")))


def latest_per_key(df: DataFrame, key: str | list[str], order_col: str) -> DataFrame:
    """Keep the row with the greatest ``order_col`` per key.

    ``max_by`` over a struct is a partial aggregate: a key with millions of
    rows is reduced map-side, never sorted in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*[F.col(c) for c in rest]), F.col(order_col)).alias("_r"))
            .select(*keys, "_r.*"))


def override_completeness(stats: DataFrame, metadata: DataFrame, genome_col: str = "genome",
                          order_col: str = "row_pos") -> DataFrame:
    """Metadata completeness wins when present; metadata is de-duplicated
    first (last row per genome), so the left join cannot multiply rows."""
    meta = latest_per_key(metadata.select(genome_col, order_col, "order_completeness"), genome_col, order_col)
    meta = meta.select(F.col(genome_col).alias("dataset_id"), F.col("order_completeness").alias("_meta_c"))
    return (stats.join(meta, "dataset_id", "left")
            .withColumn("completeness", F.coalesce(F.col("_meta_c"), F.col("completeness")))
            .drop("_meta_c"))


def annotation_matrix(seqs: DataFrame, field: str = "emapper_cog_category", level: str = "order",
                      n: int | None = 25, anchored: bool = True) -> DataFrame:
    """Protein counts per (classifier rank label, annotation value)."""
    aa = seqs.filter(_is("AA"))
    value = F.coalesce(F.nullif(F.col(field), F.lit("")), F.lit("Unannotated"))
    # count per (lineage string, value) first; ranks are parsed on those rows
    pre = aa.groupBy("taxonomy_majority", value.alias("annotation_value")).agg(F.count(F.lit(1)).alias("_n"))
    rank = clean_label(rank_raw(F.col("taxonomy_majority"), level, anchored), na_is_missing=True)
    rank_col = f"{CLASSIFIER_PREFIX}{level}"
    g = pre.groupBy(rank.alias(rank_col), "annotation_value").agg(F.sum("_n").alias("sequences"))
    return top(g, n, F.col("sequences").desc(), F.col(rank_col), F.col("annotation_value"))


def annotation_counts(seqs: DataFrame, fields: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, taxonomy_majority, field, annotation_value, sequences): proteins per lineage and value of every field.

    Fields are exploded first, so a row of the partial aggregate is one value of one field, never a
    combination of values of several.
    """
    values = [F.struct(F.lit(f).alias("field"),
                       F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("Unannotated")).alias("annotation_value")) for f in fields]
    long = seqs.filter(_is("AA")).select(*by, "taxonomy_majority", F.explode(F.array(*values)).alias("f"))
    return long.groupBy(*by, "taxonomy_majority", F.col("f.field").alias("field"),
                        F.col("f.annotation_value").alias("annotation_value")).agg(F.count(F.lit(1)).alias("sequences"))


def matrix_of_counts(counts: DataFrame, levels: tuple[str, ...] = ("order", "family", "genus", "class", "phylum", "domain"),
                     anchored: bool = True) -> DataFrame:
    """(field, level, rank_label, annotation_value, sequences) of :func:`annotation_counts`."""
    lv = [F.struct(F.lit(l).alias("level"),
                   clean_label(rank_raw(F.col("taxonomy_majority"), l, anchored)).alias("rank_label"))
          for l in levels]
    long = counts.select("field", "annotation_value", "sequences", F.explode(F.array(*lv)).alias("l"))
    return long.groupBy("field", F.col("l.level").alias("level"), F.col("l.rank_label").alias("rank_label"),
                        "annotation_value").agg(F.sum("sequences").alias("sequences"))


def annotation_matrix_all(seqs: DataFrame, fields: list[str],
                          levels: tuple[str, ...] = ("order", "family", "genus", "class", "phylum", "domain"),
                          anchored: bool = True) -> DataFrame:
    """U2 for annotations: every (field, level) matrix from ONE scan, long format
    (field, level, rank_label, annotation_value, sequences)."""
    return matrix_of_counts(annotation_counts(seqs, fields), levels, anchored)


def filter_unannotated(matrix: DataFrame, include_unannotated: bool = False) -> DataFrame:
    """P9."""
    return matrix if include_unannotated else matrix.filter(F.col("annotation_value") != "Unannotated")


def annotation_pivot(matrix: DataFrame, values: list[str] | None = None, rank_col: str = CLASSIFIER_PREFIX + "order",
                     include_unannotated: bool = True) -> DataFrame:
    """Rank x annotation-value matrix, 0 where absent.

    The columns are the values that the matrix has (one small distinct over
    its few rows); ``values`` selects columns on purpose.
    """
    m = filter_unannotated(matrix, include_unannotated)
    return m.groupBy(rank_col).pivot("annotation_value", values).agg(F.sum("sequences")).na.fill(0)


def cluster_summary(seqs: DataFrame, n: int | None = 50, anchored: bool = True, weight: str | None = None) -> DataFrame:
    """ANI clusters with genome counts, representative counts and an order label.

    ``representatives`` counts records of representative genomes (reference
    semantics); ``representative_genomes`` counts the genomes themselves.
    Records are first reduced to one row per genome (partial aggregate on
    dataset_id; cluster, flag and lineage are genome columns), so the two
    distinct counts need no Expand over the records.
    """
    nt = seqs.filter(_is("NT"))
    raw = F.nullif(F.nullif(rank_raw(F.col("taxonomy_majority"), "order", anchored), F.lit("")), F.lit("NA"))
    per_genome = nt.groupBy("dataset_id").agg(
        _records(weight).alias("_rows"),
        F.first("s_cluster", ignorenulls=True).alias("s_cluster"),
        F.first("is_skani_representative", ignorenulls=True).alias("_rep"),
        F.min(raw).alias("_order"))
    rep = F.coalesce(F.col("_rep"), F.lit(False))
    g = per_genome.groupBy(F.coalesce(F.col("s_cluster"), F.lit("Unclustered")).alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("genomes"),
        F.sum(F.when(rep, F.col("_rows")).otherwise(0)).cast("long").alias("representatives"),
        F.count_if(rep).alias("representative_genomes"),
        F.coalesce(F.min("_order"), F.lit("Unassigned")).alias("gvclass_order"),
    )
    return top(g, n, F.col("genomes").desc(), F.col("cluster_id"))


def _median(col: str, approximate: bool) -> Column:
    return F.percentile_approx(col, 0.5, 10000) if approximate else F.median(col)


def group_summary(stats: DataFrame, group_field: str = "taxonomy_order", n: int = 10,
                  approximate: bool = False) -> DataFrame:
    """Per group: genomes and medians (rounded half-even 3/2/2/2).

    Runs on genome rows.  Exact medians keep a value-count map per group
    (bounded by the genomes in the group, not by records).
    ``approximate=True`` uses fixed-size quantile sketches instead.
    """
    g = stats.groupBy(F.col(group_field).alias("group")).agg(
        F.countDistinct("dataset_id").alias("genomes"),
        F.bround(_median("genome_length_mb", approximate), 3).alias("median_length_mb"),
        F.bround(_median("gc_percent", approximate), 2).alias("median_gc"),
        F.bround(_median("completeness", approximate), 2).alias("median_completeness"),
        F.bround(_median("contamination", approximate), 2).alias("median_contamination"),
    )
    return top(g, n, F.col("genomes").desc(), F.col("group"))


def length_histogram(stats: DataFrame, color_field: str = "taxonomy_phylum", bins: int = 40,
                     value: str = "genome_length_mb") -> DataFrame:
    """Equal-width histogram of genome length per colour group.

    Range bounds come from one scalar subquery (a tiny two-phase aggregate,
    reused for both bounds), so no global window pulls rows into a single
    partition.
    """
    bounds = stats.select(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1))).cast("int")
    return (stats.filter(F.col(value).isNotNull())
            .groupBy(F.col(color_field).alias("color_group"), b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("genomes"))
            .withColumn("bin_start", F.round(lo + F.col("bin") * width, 6))
            .withColumn("bin_end", F.round(lo + (F.col("bin") + 1) * width, 6)))


def box_stats(stats: DataFrame, group_field: str = "taxonomy_order",
              metrics: tuple[str, ...] = ("completeness", "contamination"),
              approximate: bool = False) -> DataFrame:
    """Five-number summary per group and metric (exact with linear
    interpolation; ``approximate=True``: fixed-size quantile sketches)."""
    long = stats.select(F.col(group_field).alias("group"),
                        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
                                            for m in metrics])).alias("p")).select("group", "p.*")
    probs = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])
    q = F.percentile_approx(F.col("v"), probs, 10000) if approximate else F.percentile(F.col("v"), probs)
    return (long.groupBy("group", "metric").agg(q.alias("q"), F.count("v").alias("n"))
            .select("group", "metric", "n",
                    *[F.round(F.col("q")[i], 6).alias(name) for i, name in
                      enumerate(["min", "q1", "median", "q3", "max"])]))


def label_share(distribution: DataFrame, count_col: str = "genomes") -> DataFrame:
    """Each label's share of the total (pie chart); total via a scalar subquery."""
    total = distribution.select(F.sum(count_col)).scalar()
    return distribution.withColumn("share", F.round(F.col(count_col) / total, 6))


def bar_order(distribution: DataFrame, n: int | None = None, count_col: str = "genomes") -> DataFrame:
    """Ascending bar order (optionally the top n first)."""
    d = distribution if n is None else top(distribution, n, F.col(count_col).desc(), F.col("label"))
    return d.orderBy(F.col(count_col).asc(), F.col("label"))
