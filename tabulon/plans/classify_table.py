"""The classification run: profile, find the target, text features, train or select, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators import tuning
from tabulon.operators.profile import choose_mode, detect_target, id_columns, role_profile, text_dataset
from tabulon.operators.report import report_rows
from tabulon.operators.rows import drop_any_null_rows, nan_to_null, numeric_columns
from tabulon.operators.splits import row_digest
from tabulon.operators.text_features import TOP_FEATURES, text_feature_stages
from tabulon.sources.models import SavedModel

#: A text-valued column with more distinct values than this has its values hashed to WORD_SLOTS inputs instead of one each.
MAX_WORD_VALUES = 50
WORD_SLOTS = 256

# The choice that means all models, and the report lines.
FIND_BEST = "Find Best Model"
MODE_LINES = {
    "regression": "The Dataset is continuous. Use Regression",
    "classification": "The Dataset is not continuouse. Use Classification",
}
TEXT_LINE = "Text columns in your dataset: "
NO_TEXT_LINE = "There are no text columns in your dataset"


@dataclass
class ClassificationRun:
    model: SavedModel
    report: DataFrame
    scores: DataFrame
    text_columns: list[str]
    vocabulary: dict[str, list[str]]


def classify_table(df: DataFrame, model: str = FIND_BEST, target: str | None = None, key: str | None = None,
                   mode: str | None = None, dataset: str = "table", drop_any_null: bool = False,
                   top_features: int = TOP_FEATURES, search_draws: int = tuning.SEARCH_DRAWS, trees: int = 100,
                   forest_depth: int = 25, parallelism: int = 4, ignore: tuple[str, ...] = ()) -> ClassificationRun:
    spark = df.sparkSession
    df = drop_any_null_rows(nan_to_null(df), drop_any_null)
    profile = role_profile(df).persist()
    target = target or detect_target(profile)
    if target is None:
        raise ValueError("no clear target column found")
    ids = {r["column_name"] for r in id_columns(profile).collect()}
    found = text_dataset(profile, target).head()
    word_columns = profile.where(F.col("kind") == "string").select("column_name", (F.col("n_distinct") <= MAX_WORD_VALUES).alias("few")).collect()
    texts = [c for c in found["text_columns"] if c not in ids and c != target] if found["is_text_data"] else []
    mode = mode or choose_mode(df, target)
    skipped = {target, key, *ignore}
    numbers = [c for c in numeric_columns(df) if c not in skipped]
    # Words of few values become one input per value, others share hashed inputs: no column leaves the model by its size.
    usable = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in {*skipped, *texts, *ids}]
    few = {r["column_name"]: r["few"] for r in word_columns}
    words = [c for c in usable if few.get(c)]
    wide = [c for c in usable if few.get(c) is False]
    unused = [c for c in df.columns if c not in {target, *numbers, *texts, *words, *wide}]

    stages, outputs, vocabulary = [], [], {}
    if texts:
        if mode != "classification":
            raise ValueError("text features are selected by class; the target is continuous")
        keyed = df if key else df.withColumn("_key", row_digest(None, df.columns, 0))
        stages, outputs, vocabulary = text_feature_stages(
            keyed.where(F.col(target).isNotNull()), texts, key or "_key", target, top_features)
    profile.unpersist()
    if words:
        places, flags = [f"_place_{i}" for i in range(len(words))], [f"_word_{i}" for i in range(len(words))]
        stages += [StringIndexer(inputCols=words, outputCols=places, stringOrderType="alphabetAsc", handleInvalid="keep"),
                   OneHotEncoder(inputCols=places, outputCols=flags, dropLast=False)]
        outputs += flags
    for i, column in enumerate(wide):
        stages.append(FeatureHasher(inputCols=[column], outputCol=f"_hashed_{i}", numFeatures=WORD_SLOTS))
        outputs.append(f"_hashed_{i}")
    if not numbers and not outputs:
        raise ValueError("no numeric or text feature is left")
    prepared = tuning.prepare(df, target, numbers, mode, key, stages, outputs)
    with tuning.held(prepared) as data:
        if model == FIND_BEST:
            tuned = None
            if mode == "classification" and search_draws:
                tuned = tuning.random_search(data, search_draws).estimator
            chosen = tuning.select_model(
                data, tuning.candidates(mode, tuned, trees, forest_depth), parallelism=parallelism)
            name, table, scores = chosen.best, chosen.table, {"score": chosen.score}
            fitted = chosen.pipeline.fit(data.frame)
        else:
            fitted, scores = tuning.train_one(data, model)
            name = model
            table = spark.createDataFrame(
                [(0, model, "hold-out", scores["score"], None)],
                "order int, model string, protocol string, score double, seconds double")
    fields = [f for f in df.schema if f.name in [*numbers, *texts, *words, *wide]]
    saved = SavedModel(tuning.full_model(data, fitted), dataset, name, 1, target, mode, fields, data.labels, scores)
    lines = [
        ("model", "name", name), ("model", "target", target),
        ("data", "mode", MODE_LINES[mode]),
        ("data", "unused columns", ", ".join(unused)),
        ("data", "hashed columns", ", ".join(wide)),
        ("data", "text columns", f"{TEXT_LINE}{texts}" if texts else NO_TEXT_LINE),
        *[("vocabulary", c, " ".join(terms)) for c, terms in vocabulary.items()],
        *[("score", k, v) for k, v in scores.items()],
        *[("models tried", r["model"], r["score"]) for r in table.orderBy("order").collect()],
    ]
    return ClassificationRun(saved, report_rows(spark, lines), table, texts, vocabulary)
