"""The whole analysis in one application: raw files to stored tables to every report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..config import FOREST, RULES, ForestConfig, RuleConfig
from ..operators import files
from ..operators.staging import cleared_after
from ..schemas import LOAD_ORDER, RAW_FILES
from ..sources.csv_tables import Intake, clean_and_write, read_processed
from ..sources.reports import write_report
from ..sources.tables import current_load, load_tables, read_load
from ..steps import Steps, code_fingerprint, fingerprint
from . import classifier, dataset, distortion, evaluation, explain, retention
from .lines import integrate_lines


@dataclass
class RunResult:
    """Paths of everything a run wrote."""

    processed: dict[str, str]
    lines: str
    model_data: str
    reports: dict[str, str] = field(default_factory=dict)
    unparsed_dates: int = 0  # header dates that fit no format
    extra_records: dict[str, int] = field(default_factory=dict)  # left out: more fields than the header
    date_formats: tuple[str, ...] = ()  # the formats header dates were read with; none: ISO notation
    reused: tuple[str, ...] = ()  # steps of an earlier run that did not have to be run again


def store(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def distortion_reports(lines: DataFrame, rules: RuleConfig = RULES) -> dict[str, DataFrame]:
    tables = distortion.distortion_tables(lines, rules)
    return {
        "RQ2_Tb1/Distortion_Summary": tables["Summary"],
        "RQ2_Tb1/Meta": tables["Meta"],
        "RQ2_Tb2/Distortion_by_Segment": tables["Segments"],
        "RQ2_Tb3/Top_Harmful_Transactions": distortion.top_harmful(lines, rules),
        "RQ2_Tb4/DayOfWeek_Profile": distortion.day_of_week_profile(lines),
        "RQ2_Fig1/Daily_Revenue": distortion.daily_revenue(lines, rules),
        "RQ2_Fig1/Weekly_Distortion": distortion.weekly_distortion(lines, rules),
        "RQ2_Fig3/Line_Total_Histogram": distortion.line_total_histogram(lines, rules),
    }


def retention_reports(lines: DataFrame, rules: RuleConfig = RULES) -> dict[str, DataFrame]:
    flagged = retention.flag_lines(lines, rules)
    tables = retention.retention_tables(flagged, rules)
    return {
        "RQ3_Tb1/AOV_Comparison": retention.aov_comparison(flagged, rules),
        "RQ3_Tb1/Revenue_Bias": retention.revenue_bias(flagged),
        "RQ3_Tb2/Overall_Retention": tables["Overall"],
        "RQ3_Tb2/Retention_by_Segment": tables["Segments"],
        "RQ3_Tb2/Retention_by_Category_Top15": tables["Categories"],
        "RQ3_Tb2/Retention_by_Month": tables["Months"],
        "RQ3_Tb3/Top_Strategic_Outliers": retention.top_strategic(flagged, rules),
        "RQ3_Tb4/Monthly_Revenue_Comparison": retention.monthly_comparison(flagged),
        "RQ3_Fig3/Scatter_Series": retention.scatter_series(lines, rules),
    }


def classifier_reports(data: DataFrame, forest: ForestConfig = FOREST) -> dict[str, DataFrame]:
    """One model for both the evaluation and the contribution tables."""
    encoded = classifier.split_and_encode(data, forest.report_test_share, forest)
    model = classifier.train_forest(encoded, forest.seed, forest)
    predictions = classifier.predict(model, encoded)
    importance = classifier.feature_importance(model, encoded.features)
    return {
        "RQ1_Tb1/Class_Distribution": dataset.class_distribution(data),
        "RQ1_Tb1/Classification_Report": evaluation.classification_report(predictions),
        "RQ1_Tb1/Confusion_Matrix": evaluation.confusion_matrix(predictions),
        "RQ1_Tb2/Feature_Importance": importance,
        "RQ1_Tb3/Contextual_Contribution": evaluation.contextual_contribution(importance),
        "RQ1_Tb3/Bucket_Breakdown": evaluation.bucket_breakdown(importance),
        "RQ1_Tb3/All_Features": importance,
    }


def validation_reports(data: DataFrame, rules: RuleConfig = RULES,
                       forest: ForestConfig = FOREST) -> dict[str, DataFrame]:
    encoded = classifier.split_and_encode(data, forest.validation_test_share, forest)
    models = explain.retrain(encoded, forest)
    # One of the retrained models usually is the one with the report's own seed.
    by_seed = dict(zip(forest.retrain_seeds, models, strict=True))
    model = by_seed.get(forest.seed) or classifier.train_forest(encoded, forest.seed, forest)
    ruled = evaluation.add_rule_class(classifier.predict(model, encoded), rules)
    scores = explain.permutation_importances(models, encoded, forest)
    top = explain.top_features_per_run(scores, forest.listed_features)
    return {
        "RQ4_Tb1/Rule_Alignment_Summary": evaluation.rule_alignment(ruled),
        "RQ4_Tb1/Rule_Alignment_Breakdown": evaluation.rule_alignment_breakdown(ruled),
        "RQ4_Tb2/Consistency_Summary": explain.topk_jaccard(top, forest.compared_features),
        "RQ4_Tb2/Top_Features_Per_Run": top,
        "RQ4_Tb2/Permutation_Importance": scores,
        "RQ4_Tb2/SHAP_Importance": explain.shap_report(model, encoded),
        "RQ4_Tb3/Prediction_Stability": explain.prediction_stability(explain.retrain_predictions(models, encoded)),
    }


def run_all(spark: SparkSession, raw_dir: str, out_dir: str, rules: RuleConfig = RULES, forest: ForestConfig = FOREST,
            on_violation: str = "fail", report_format: str = "parquet", date_formats: Sequence[str] | str = (),
            multi_line: bool = True, resume: bool = True) -> RunResult:
    """Clean, load, integrate, report. Every step overwrites its own output, so a run can simply be repeated.

    A missing input, a record with more fields than its header or a broken constraint ends the run before later steps
    start; with ``on_violation="quarantine"`` such records are left out and counted, and broken rows set aside.
    ``date_formats`` are the patterns header dates may have (none: ISO notation; ``"infer"``: see ``clean_and_write``); how many fit none
    is in the result. ``multi_line``: see ``read_csv``.

    ``out_dir`` keeps a list of the steps that are done, each with a fingerprint of the raw files (paths, sizes, times), the settings and the
    code that its output follows from. With ``resume`` a step whose fingerprint is the same, and whose output is there, is not
    run again: a run that ended half-way goes on where it stopped. One run at a time per ``out_dir``.
    """
    with cleared_after(spark):
        return _run(spark, raw_dir, out_dir, rules, forest, on_violation, report_format, date_formats, multi_line, resume)


def _run(spark: SparkSession, raw_dir: str, out_dir: str, rules: RuleConfig, forest: ForestConfig, on_violation: str,
         report_format: str, date_formats: Sequence[str] | str, multi_line: bool, resume: bool) -> RunResult:
    steps = Steps(spark, f"{out_dir}/_steps.json", resume)
    raw = fingerprint(code_fingerprint(), [files.listed(spark, f"{raw_dir}/{f}") for f in RAW_FILES.values()])

    cleaned = fingerprint(raw, on_violation, date_formats, multi_line)
    extra = "drop" if on_violation == "quarantine" else "fail"
    intake = Intake(**steps.done("clean", cleaned, lambda: asdict(clean_and_write(
        spark, raw_dir, f"{out_dir}/processed", date_formats, multi_line, extra)), lambda made: made["paths"].values()))
    result = RunResult(intake.paths, f"{out_dir}/lines", f"{out_dir}/model_data", unparsed_dates=intake.unparsed_dates,
                       extra_records=intake.extra_records, date_formats=tuple(intake.date_formats))
    target = f"{out_dir}/tables"

    def load() -> str:
        load_tables(read_processed(spark, intake.paths, multi_line), target, on_violation)
        return current_load(spark, target)

    loaded = fingerprint(cleaned, "load")
    version = steps.done("load", loaded, load, lambda made: [f"{made}/{name}" for name in LOAD_ORDER])
    integrated = fingerprint(loaded, "lines")
    steps.done("lines", integrated, lambda: store(integrate_lines(read_load(spark, version)), result.lines), lambda _: [result.lines])
    lines = spark.read.parquet(result.lines)

    def report(step: str, settings: str, make: Callable[[], dict[str, DataFrame]]) -> None:
        result.reports.update(steps.done(step, settings, lambda: write_report(make(), f"{out_dir}/reports", report_format),
                                         lambda paths: paths.values()))

    settings = fingerprint(integrated, asdict(rules), report_format)
    report("distortion", settings, lambda: distortion_reports(lines, rules))
    report("retention", settings, lambda: retention_reports(lines, rules))
    modelled = fingerprint(integrated, asdict(rules), "model data")
    steps.done("model data", modelled, lambda: store(dataset.model_dataset(lines, rules), result.model_data), lambda _: [result.model_data])
    data = spark.read.parquet(result.model_data)
    settings = fingerprint(modelled, asdict(forest), report_format)
    report("classifier", settings, lambda: classifier_reports(data, forest))
    report("validation", settings, lambda: validation_reports(data, rules, forest))
    result.reused = tuple(steps.reused)
    return result
