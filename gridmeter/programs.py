"""One function for each program: from its input tables to all of its result tables, by name.

Each returns a dict of DataFrames, which are lazy but for the tables that several of them share: those are written once to the session's
shared folder. save() writes results, never over older ones. Empty inputs give empty results with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import catalog, evidence, fingerprint, layout, reports, rules, sampling, sensitivity, tables
from .sources import sinks
from .sources.scratch import written

Results = dict[str, DataFrame]


def save(results: Results, folder: str, kind: str = "parquet") -> dict[str, bool]:
    """Writes each result below folder; tells which were written. One that is there already stays as it is."""
    return {name: sinks.write_once(df, f"{folder.rstrip('/')}/{name}", kind) for name, df in results.items()}


def score_run(checks: DataFrame, manifest: DataFrame, levels: DataFrame | None = None, dimensions: tuple[str, ...] = ("gov_org", "stat_type"), contrast: str = "stat_type", limit: int | None = None) -> Results:
    """Rule scoring of a run.

    checks: stem, tbl, rule_id, passed, confidence, severity, n_violations, ord; manifest: stem, weight and the dimensions, a row for each file;
    levels: file, level, score, forced_zero. limit: the first files by name only, as the program's option has it.
    files (a row for each file and rule), overall, by_stratum, rates (dimension x rule), contrasts with bootstrap intervals, and levels.
    """
    if limit is not None:
        manifest = manifest.orderBy("stem").limit(limit)
    files = written(rules.file_rollup(checks.join(manifest.select("stem"), "stem", "left_semi")).join(manifest.select("stem", "weight", *dimensions), "stem"))
    sizes = manifest.agg(F.count("*").alias("n_files"))  # files without any check count as well
    count = lambda c: F.count_if(c)
    used = ~F.col("skipped")
    by = files.groupBy("rule_id", contrast).agg(count(used).alias("n_applicable"), count(used & F.col("passed")).alias("n_pass")).withColumn("pass_rate", F.try_divide("n_pass", "n_applicable"))
    pairs = rules.contrasts(by, contrast)
    strata_sizes = rules.strata(manifest.select("stem", *dimensions), list(dimensions)).groupBy("dimension", "value").agg(F.count("*").alias("n_files"))
    out = {
        "files": files,
        "overall": rules.with_interval(rules.accumulate(files, sizes, [])),
        "by_stratum": rules.with_interval(rules.accumulate(rules.strata(files, list(dimensions)), strata_sizes, ["dimension", "value"])),
        "grouping_sets": rules.stats_grouping_sets(files, list(dimensions)),
        "contrasts": pairs,
        "contrast_intervals": rules.bootstrap_intervals(pairs),
    }
    if levels is not None:
        out["levels"] = rules.level_stats(levels.join(manifest.select(F.col("stem").alias("file")), "file", "left_semi"))
    return out


def rule_evidence(documents: DataFrame, items: DataFrame, file_checks: DataFrame, weights: DataFrame, group: str) -> Results:
    """States of files by rule from nested evidence.

    documents: stem, sheets (name, areas (range, checks (rule_id, tri_state, violations))); items: stem; file_checks: stem, rule_id, passed, skipped;
    weights: stem, weight and the group. checks, violations (unique ones, counted), states (the dense grid), rates.
    """
    checks = written(evidence.flatten_checks(documents))
    held = evidence.flatten_violations(checks).withColumn("ord", F.col("violation_no")).withColumnsRenamed({"violation_severity": "severity"})
    states = written(evidence.file_rule_states(items, checks.select("stem", "rule_id", "tri_state"), file_checks))
    return {"checks": checks, "violation_counts": evidence.violation_counts(held), "states": states, "rates": evidence.state_rates(states, weights, group)}


def evaluate(gt: DataFrame, pred: DataFrame, truth_roles: DataFrame | None = None, pred_roles: DataFrame | None = None, role_keys: tuple[str, ...] = ("doc", "sheet", "row", "col")) -> Results:
    """Layout evaluation of predicted tables (doc, sheet, idx, four sides, abstain) against true ones.

    eob (micro, by tolerance), eob_by_file, over_split, areas (micro), iou (quantiles by side), iou_histogram, counts, and of roles (keys, ord, role)
    confusion and macro_f1.
    """
    gt, pred = layout.kept(gt), layout.kept(layout.visible(pred))
    by_sheet = written(layout.eob_by_sheet(gt, pred))
    best = written(layout.best_iou(gt, pred))
    by_file = layout.eob(by_sheet, ["doc"])
    out = {
        "eob": layout.eob(by_sheet, []),
        "eob_by_file": by_file,
        "over_split": sensitivity.over_split(by_file),
        "areas": layout.coverage(layout.union_areas(gt, pred), []),
        "iou": layout.summarize(best, ["side"], "best"),
        "iou_histogram": layout.histogram(best, ["side"], "best"),
        "counts": layout.evaluation_summary(gt, pred),
    }
    if truth_roles is not None and pred_roles is not None:
        confusion = written(layout.role_confusion(truth_roles, pred_roles, list(role_keys)))
        out |= {"confusion": confusion, "macro_f1": layout.macro_f1(confusion)}
    return out


def compare(base_levels: DataFrame, variant_levels: DataFrame, base_states: DataFrame, variant_states: DataFrame, families: DataFrame) -> Results:
    """Score sensitivity: a baseline against perturbed runs.

    Levels: file, level, score, forced_zero, and variant on the variants' side; states: file, rule_id, state, likewise; families: variant, family.
    level_deltas and unchanged (by variant), transitions (by variant), flip_rates (by rule and family). Every variant has rows of its own.
    """
    variants = [r.variant for r in families.select("variant").distinct().orderBy("variant").collect()]  # a design's list, some 26
    of = lambda f, base, rows: [f(base, rows.filter(F.col("variant") == v).drop("variant")).withColumn("variant", F.lit(v)) for v in variants]
    union = lambda dfs: dfs[0].unionByName(union(dfs[1:])) if len(dfs) > 1 else dfs[0]
    out = {"flip_rates": sensitivity.flip_rates(base_states, variant_states, families)}
    if variants:
        out["level_deltas"] = union(of(sensitivity.level_deltas, base_levels, variant_levels))
        out["unchanged"] = union(of(sensitivity.all_levels_unchanged, base_levels, variant_levels))
        out["transitions"] = union(of(sensitivity.rule_transitions, base_states, variant_states))
    return out


def dedup(resources: DataFrame, frame: DataFrame) -> Results:
    """Templates of a catalogue: resources (survey, stem, stem_region, table_no, table_name, survey_date, format, url, resource_id, organization, ord), frame (gov_stats_code, ...).

    templates (with the frame's names), summary by survey, dropped formats, and the stems that spell periods.
    """
    kept = written(catalog.kept_formats(resources))
    found = written(catalog.templates(kept))
    return {"templates": catalog.with_frame(found, frame), "summary": catalog.template_summary(kept, found), "dropped": catalog.dropped_formats(resources), "period_encoded": catalog.period_encoded(kept)}


def stratified(pool: DataFrame, per_cell: int, seed: int) -> Results:
    """A stratified sample of a pool (id, cell, survey): selected with attempt and status, a summary of every cell, and the funnel."""
    picked = written(sampling.seeded_stratified(pool, "cell", "id", "survey", per_cell, seed))
    selected = pool.join(picked, ["cell", "id"])
    summary = written(sampling.stratum_summary(pool, selected, pool.select("cell").distinct(), per_cell))
    return {"selected": selected, "summary": summary, "funnel": reports.funnel(summary)}


def shape_report(cells: DataFrame, merged: DataFrame, manifest: DataFrame, spot_n: int = 60) -> Results:
    """Fingerprints of files: cells (doc, sheet, row, col, numeric, value), merged (doc, sheet, n_merged), manifest (doc, survey, shape, structural_key).

    sheets, files (with shape and key), shapes, duplicates (equal keys in a survey), queue (a spot check, shapes in turn), manifest with the labels set.
    """
    sheets = written(fingerprint.sheet_features(cells, merged))
    files = written(fingerprint.file_features(sheets).withColumns({"shape": fingerprint.shape(), "structural_key": fingerprint.structural_key()}))
    named = files.join(manifest.select("doc", "survey"), "doc")
    return {
        "sheets": sheets,
        "files": files,
        "shapes": fingerprint.shape_counts(files),
        "duplicates": fingerprint.duplicates(named),
        "queue": sampling.round_robin(files.select("doc", "shape"), ["shape"], [F.col("doc").asc()], spot_n),
        "manifest": fingerprint.with_labels(manifest, files),
    }


def extension_breakdown(files: DataFrame, n: int = 20) -> Results:
    """Old and new formats of files (file, ext, year, survey, status): by survey, by years, the top surveys, and the statuses."""
    return {"by_survey": reports.extension_crosstab(files, "survey"), "by_years": reports.year_buckets(files), "top_surveys": reports.top(files, "survey", n), "statuses": reports.status_counts(files, ("ok", "error", "timeout", "empty"))}


def survey_sizes(log: DataFrame) -> Results:
    """A fetch log (survey, error, number, n_datasets): with status, in order, and the totals over those that are ok."""
    done = catalog.fetch_status(log)
    return {"surveys": done, "totals": tables.fetch_summary(done), "errors": tables.error_records(done)}
