"""Profile, clean, chart and model tables of any size with Spark."""

from tabletools import constants
from tabletools.functions.kinds import dtype_map, select_kind
from tabletools.operators.charts import (
    area_data, bar_data, box_data, chart_data, choose_charts, heatmap_data, histogram_data, line_data,
    pie_data, recommend_charts, scatter_bins, scatter_data, validate_chart_specs, violin_data, violin_density)
from tabletools.operators.cleaning import (
    CleaningModel, cleaning_report, clip_outliers, date_pattern_rate, drop_exact_duplicates,
    drop_sparse_columns, duplicate_count, fill_median, fill_mode, fit_cleaning, iqr_fences, null_profile,
    outlier_counts, parse_datetimes, run_cleaning)
from tabletools.operators.model import (
    accuracy, cardinality_gate, classification_metrics, encode_target, f1_score, feature_columns, feature_importances,
    fill_features, forest_classify, forest_regress, label_encode, r2_score, regression_metrics, rmse, run_automl,
    train_test_split)
from tabletools.operators.profile import (
    anomaly_flags, category_topk, compute_analytics, correlation_matrix, correlation_pairs, kpi_summary,
    missing_profile, null_counts, numeric_summary, profile_text, raw_analytics, raw_numeric_summary,
    strongest_pair, table_shape)
from tabletools.operators.reports import (
    clean_bullets, extract_slides, extract_tagged_json, markdown_blocks, markdown_sections,
    recommendations, section_lines, section_map, slides_or_sections, strip_tagged_line)
from tabletools.plans.adhoc import ask_sql
from tabletools.plans.run import RunResult, analyse_file, analyse_table
from tabletools.sources.files import (
    infer_types, load_table, preview, read_csv_table, save_results, write_csv_table)
from tabletools.sources.jdbc import postgres_url, read_sql_query
from tabletools.sources.runs import drop_old_runs, publish_results, read_results
from tabletools.sources.staging import cleanup, stage
from tabletools.streaming.clean_stream import append_clean_stream, clean_stream
from tabletools.streaming.refit_stream import append_distinct_stream, distinct_stream, refit_cleaning, stream_rows

__all__ = [name for name in dir() if not name.startswith("_")]
