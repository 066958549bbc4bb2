"""Dataset descriptions: column roles, codebooks, label contract."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. Everything down to the next rule must equal the values used by
# the published benchmark files, otherwise results cannot match.

SEED = 42
TEST_FRACTION = 0.2
CV_FOLDS = 5
POSITIVE_THRESHOLD = 0.5
SCORING_BATCH = 150

UNKNOWN = "unknown"
MISSING_MARK = "?"
INVALID_LABEL = "__invalid__"
ANSWER_LABELS = ("negative", "positive")
RESULT_KEY = ("dataset", "model", "serialization")
QUALITY_METRICS = ("test_f1_macro", "test_accuracy", "test_precision", "test_recall", "test_auc")
TIME_METRICS = ("train_time_seconds", "prediction_time_seconds")
STYLE_COLUMNS = {
    "text_template": "serialized_text",
    "json": "serialized_json",
    "llm": "serialized_llm",
}
DISPLAY_NAMES = {
    "lightgbm": "LightGBM",
    "tabicl_v2": "TabICL v2",
    "tabpfn": "TabPFN",
    "tarte": "TARTE",
    "xgboost": "XGBoost",
}
ANSWER_SOURCE, ANSWER_PREFIX = "tabllm", "TabLLM"
ENCODER_SOURCE, ENCODER_PREFIX = "tarte", "TARTE"

# Event log of the diabetes table: code -> event name.
EVENT_CODES = {
    33: "insulin_regular",
    34: "insulin_nph",
    35: "insulin_ultralente",
    48: "glucose_unspecified",
    57: "glucose_unspecified2",
    58: "glucose_pre_breakfast",
    59: "glucose_post_breakfast",
    60: "glucose_pre_lunch",
    61: "glucose_post_lunch",
    62: "glucose_pre_supper",
    63: "glucose_post_supper",
    64: "glucose_pre_snack",
    65: "hypoglycemic_symptoms",
    66: "meal_typical",
    67: "meal_more_than_usual",
    68: "meal_less_than_usual",
    69: "exercise_typical",
    70: "exercise_more_than_usual",
    71: "exercise_less_than_usual",
    72: "special_event",
}
DIABETES_SUMS = {"insulin_regular": 33, "insulin_nph": 34, "insulin_ultralente": 35}
DIABETES_STATS = {"glucose": (48, 57, 58, 59, 60, 61, 62, 63, 64)}
DIABETES_EVENTS = {"hypoglycemic_events": 65}
DIABETES_ORDINALS = {
    "meal_pattern": {68: 0, 66: 1, 67: 2},
    "exercise_pattern": {71: 0, 69: 1, 70: 2},
}
DIABETES_ZERO_FILLED = (
    "insulin_regular_doses",
    "insulin_nph_doses",
    "insulin_ultralente_doses",
    "glucose_count",
    "hypoglycemic_events",
    "insulin_regular_total",
    "insulin_nph_total",
    "insulin_ultralente_total",
)
DIABETES_MEAN_FILLED = (
    "glucose_mean",
    "glucose_min",
    "glucose_max",
    "glucose_std",
    "meal_pattern",
    "exercise_pattern",
)

# Fixed-width token file of the heart table: token position -> column.
HEART_BLOCK = 76
HEART_RECORDS = 303
HEART_POSITIONS = {
    2: "age",
    3: "sex",
    8: "cp",
    9: "trestbps",
    11: "chol",
    15: "fbs",
    18: "restecg",
    31: "thalach",
    37: "exang",
    39: "oldpeak",
    40: "slope",
    43: "ca",
    50: "thal",
    57: "num",
}
HEART_SENTINEL = "-9"
HEART_TARGET_DOMAIN = (0, 1, 2, 3, 4)
HEART_CATEGORICAL = ("sex", "cp", "fbs", "restecg", "exang", "slope", "ca", "thal")
HEART_NUMERIC = ("age", "trestbps", "chol", "thalach", "oldpeak")

# Headerless file of the hepatitis table.
HEPATITIS_COLUMNS = (
    "Class",
    "Age",
    "Sex",
    "Steroid",
    "Antivirals",
    "Fatigue",
    "Malaise",
    "Anorexia",
    "Liver Big",
    "Liver Firm",
    "Spleen Palpable",
    "Spiders",
    "Ascites",
    "Varices",
    "Bilirubin",
    "Alk Phosphate",
    "Sgot",
    "Albumin",
    "Protime",
    "Histology",
)
HEPATITIS_CATEGORICAL = (
    "Sex",
    "Steroid",
    "Antivirals",
    "Fatigue",
    "Malaise",
    "Anorexia",
    "Liver Big",
    "Liver Firm",
    "Spleen Palpable",
    "Spiders",
    "Ascites",
    "Varices",
    "Histology",
)
HEPATITIS_NUMERIC = ("Age", "Bilirubin", "Alk Phosphate", "Sgot", "Albumin", "Protime")
HEPATITIS_TARGET = {1: 1, 2: 0}

# Codebooks.
LEVELS = {"0": "less", "1": "typical", "2": "more"}
NO_YES = {"1": "no", "2": "yes"}
HEART_CATEGORIES = {
    "sex": {"0": "female", "1": "male"},
    "cp": {
        "1": "typical angina",
        "2": "atypical angina",
        "3": "non-anginal pain",
        "4": "asymptomatic",
    },
    "fbs": {"0": "false", "1": "true"},
    "restecg": {
        "0": "normal",
        "1": "ST-T wave abnormality",
        "2": "left ventricular hypertrophy",
    },
    "exang": {"0": "no", "1": "yes"},
    "slope": {"1": "upsloping", "2": "flat", "3": "downsloping"},
    "ca": {
        "0": "0 major vessels",
        "1": "1 major vessel",
        "2": "2 major vessels",
        "3": "3 major vessels",
    },
    "thal": {"3": "normal", "6": "fixed defect", "7": "reversible defect"},
}
HEPATITIS_CATEGORIES = {
    "Sex": {"1": "male", "2": "female"},
    **{name: NO_YES for name in HEPATITIS_CATEGORICAL if name != "Sex"},
}
TASKS = {
    "diabetes": "Predict whether the patient will have a hypoglycemic event tomorrow.",
    "heart": "Predict whether the patient has heart disease.",
    "hepatitis": "Predict the hepatitis outcome.",
}

# Wording of the rendered texts.
SENTENCE = ("The ", " is ", ".")
RECORD_LEAD = "The patient record describes a person with "
REWRITE_HEAD = (
    "Convert this tabular medical patient record into one concise natural-language sentence.\n"
    "Do not infer or mention the target label. Preserve all feature values.\n"
    "\n"
    "Record:\n"
)
REWRITE_TAIL = "\n\nSentence:"
PROMPT_HEAD = "You are performing a binary medical classification task.\n\nInput:\n"
PROMPT_TAIL = (
    "\n"
    "\n"
    "Task:\n"
    "{task}\n"
    "\n"
    "Label mapping:\n"
    '- Answer "{positive}" when the predicted outcome is "{positive_target}".\n'
    '- Answer "{negative}" when the predicted outcome is "{negative_target}".\n'
    "\n"
    "Rules:\n"
    '- Choose exactly one of these labels: "{positive}" or "{negative}".\n'
    "- Do not explain your reasoning.\n"
    "- Do not output any text other than the label.\n"
    "- If uncertain, choose the most likely label.\n"
    "\n"
    "Answer:"
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class DatasetSpec:
    """What the serialization and answer jobs must know about one table."""

    name: str
    target: str = "target"
    target_labels: dict[str, str] = field(default_factory=dict)
    categories: dict[str, dict[str, str]] = field(default_factory=dict)
    levels: dict[str, dict[str, str]] = field(default_factory=dict)
    numeric: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    task: str = ""
    positive: str = ""

    @property
    def choices(self) -> list[str]:
        return list(self.target_labels.values())

    @property
    def negative(self) -> str:
        return negative_of(self.choices, self.positive)


def negative_of(choices: list[str], positive: str) -> str:
    """The one label that is not the positive one; the contract allows exactly two."""
    others = [label for label in choices if label != positive]
    if len(choices) != 2 or len(others) != 1:
        raise ValueError(f"exactly two target labels and one positive label are required, got {choices} / {positive!r}")
    return others[0]


DIABETES = DatasetSpec(
    name="diabetes",
    target_labels={"0": "no hypoglycemic event tomorrow", "1": "hypoglycemic event tomorrow"},
    levels={"meal_pattern": LEVELS, "exercise_pattern": LEVELS},
    numeric=(
        "insulin_regular_total",
        "insulin_regular_doses",
        "insulin_nph_total",
        "insulin_nph_doses",
        "insulin_ultralente_total",
        "insulin_ultralente_doses",
        "glucose_mean",
        "glucose_min",
        "glucose_max",
        "glucose_std",
        "glucose_count",
        "hypoglycemic_events",
    ),
    drop=("patient_id", "day"),
    task=TASKS["diabetes"],
    positive="hypoglycemic event tomorrow",
)
HEART = DatasetSpec(
    name="heart",
    target_labels={"0": "no heart disease", "1": "heart disease"},
    categories=HEART_CATEGORIES,
    numeric=HEART_NUMERIC,
    task=TASKS["heart"],
    positive="heart disease",
)
HEPATITIS = DatasetSpec(
    name="hepatitis",
    target_labels={"0": "live", "1": "die"},
    categories=HEPATITIS_CATEGORIES,
    numeric=HEPATITIS_NUMERIC,
    task=TASKS["hepatitis"],
    positive="die",
)
DATASETS = {spec.name: spec for spec in (DIABETES, HEART, HEPATITIS)}
