import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from tabspark import spec
from tabspark.functions import answers as A
from tabspark.functions import text as X
from tabspark.functions.display import cell_text, model_label, percent_text
from tabspark.plans.answers import answer_confusion, evaluate_responses, require_known_targets
from tabspark.plans.serialize import serialize_table


def test_float_text_is_pythons(spark):
    rng = random.Random(3)
    numbers = [0.0, -0.0, 16.0, 12.288205727444508, 12345678.0, 1e-4, 1e-05, 1e16, 1e23, 2.0**-44, float("inf"), -1e22, 123456.789]
    numbers += [rng.random() * 10 ** rng.randint(-9, 17) * rng.choice([1, -1]) for _ in range(5000)]
    numbers += [round(rng.random(), rng.randint(1, 6)) * 10.0 ** rng.randint(-9, 20) for _ in range(5000)]
    numbers += [struct.unpack("d", struct.pack("Q", rng.getrandbits(63)))[0] for _ in range(3000)]
    numbers = [x for x in numbers if x == x]
    df = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", X.py_float_str(F.col("x")).alias("t"))
    assert [(r["x"], r["t"]) for r in df.collect() if repr(r["x"]) != r["t"]] == []


def test_json_text_is_pythons(spark):
    texts = ['a"b', "x\\y", "é", "日本語", "😀 ok", "tab\t nl\n cr\r", "\x07\x7f", "", "[x] {y} ~", "\\u00e9 é", None]
    df = spark.createDataFrame([(t, i, i / 4, i % 2 == 0) for i, t in enumerate(texts)], "`a b` string, n bigint, x double, ok boolean")
    got = df.select("n", X.text_json(df.schema.fields).alias("j")).collect()
    for r in got:
        i = r["n"]
        want = {"a b": "unknown" if texts[i] is None else texts[i], "n": i, "x": i / 4, "ok": i % 2 == 0}
        assert r["j"] == json.dumps(want, ensure_ascii=True)


HEART_ROW = {
    "age": 49.0, "sex": 1.0, "cp": 3.0, "trestbps": 120.0, "chol": 188.0, "fbs": 0.0, "restecg": 0.0, "thalach": 139.0,
    "exang": 0.0, "oldpeak": 2.0, "slope": 2.0, "ca": 3.0, "thal": 7.0, "target": 0,
}
HEART_TEXT = (
    "The age is 49.0. The sex is male. The cp is non-anginal pain. The trestbps is 120.0. The chol is 188.0. The fbs is false."
    " The restecg is normal. The thalach is 139.0. The exang is no. The oldpeak is 2.0. The slope is flat."
    " The ca is 3 major vessels. The thal is reversible defect."
)
HEART_PROMPT = f"""You are performing a binary medical classification task.

Input:
{HEART_TEXT}

Task:
Predict whether the patient has heart disease.

Label mapping:
- Answer "positive" when the predicted outcome is "heart disease".
- Answer "negative" when the predicted outcome is "no heart disease".

Rules:
- Choose exactly one of these labels: "positive" or "negative".
- Do not explain your reasoning.
- Do not output any text other than the label.
- If uncertain, choose the most likely label.

Answer:"""


def heart(spark):
    schema = ", ".join(f"{k} {'int' if k == 'target' else 'double'}" for k in HEART_ROW)
    return spark.createDataFrame([tuple(HEART_ROW.values())], schema)


def test_published_prompt(spark):
    out = serialize_table(heart(spark), spec.HEART)
    assert out.columns == ["serialized_text", "serialized_json", "serialized_llm", "target_col"]
    row = out.withColumn(
        "prompt", X.class_prompt(F.col("serialized_text"), spec.HEART.task, spec.HEART.choices, spec.HEART.positive)
    ).first()
    assert row["serialized_text"] == HEART_TEXT and row["prompt"] == HEART_PROMPT and row["target_col"] == "no heart disease"
    assert row["serialized_json"].startswith('{"age": 49.0, "sex": "male", "cp": "non-anginal pain"')
    assert row["serialized_llm"].startswith("The patient record describes a person with age 49.0, sex male, cp non-")


def test_style_order_is_fixed_and_styles_can_be_replaced(spark):
    out = serialize_table(heart(spark), spec.HEART, ["llm", "text_template"], custom={"llm": lambda fields: F.lit(len(fields)).cast("string")})
    assert out.columns == ["serialized_text", "serialized_llm", "target_col"]
    assert out.first()["serialized_llm"] == "13"


def test_published_diabetes_text(spark):
    features = [16.0, 2.0, 13.0, 1.0, 0.0, 0.0, 114.0, 100.0, 123.0, 12.288205727444508, 3.0, 0.0, 2.0, 1.0]
    names = [*spec.DIABETES.numeric, "meal_pattern", "exercise_pattern"]
    df = spark.createDataFrame([(*features, 0, 7)], ", ".join(f"{n} double" for n in names) + ", target int, patient_id int")
    assert serialize_table(df, spec.DIABETES, ["text_template"]).first()["serialized_text"] == (
        "The insulin_regular_total is 16.0. The insulin_regular_doses is 2.0. The insulin_nph_total is 13.0."
        " The insulin_nph_doses is 1.0. The insulin_ultralente_total is 0.0. The insulin_ultralente_doses is 0.0."
        " The glucose_mean is 114.0. The glucose_min is 100.0. The glucose_max is 123.0. The glucose_std is 12.288205727444508."
        " The glucose_count is 3.0. The hypoglycemic_events is 0.0. The meal_pattern is more. The exercise_pattern is typical."
    )


def test_two_labels_are_required(spark):
    with pytest.raises(ValueError):
        X.class_prompt(F.lit("x"), "t", ["a", "b", "c"], "a")
    with pytest.raises(ValueError):
        X.class_prompt(F.lit("x"), "t", ["a", "b"], "c")


HEART_LABELS = ["heart disease", "no heart disease"]


@pytest.mark.parametrize(
    "output, labels, want",
    [
        ("negative.", None, ("negative", "parsed")),
        ("POSITIVE!", None, ("positive", "parsed")),
        ('{"positive": true}', None, ("positive", "parsed")),
        ('{"answer": "positive"}', None, ("positive", "parsed")),
        ('{"positive"}', None, ("positive", "parsed")),
        ("positive, yes positive", None, ("positive", "parsed")),
        ("non-positive", None, ("positive", "parsed")),
        ("positively", None, ("__invalid__", "non_relevant")),
        (None, None, ("__invalid__", "non_relevant")),
        ("", None, ("__invalid__", "non_relevant")),
        ("positive or negative", None, ("__invalid__", "ambiguous")),
        ("No heart disease", HEART_LABELS, ("no heart disease", "parsed")),
        ("no heart disease. heart disease", HEART_LABELS, ("__invalid__", "ambiguous")),
        ("Heart-Disease!", HEART_LABELS, ("heart disease", "parsed")),
    ],
)
def test_published_answers(spark, output, labels, want):
    df = spark.createDataFrame([(output,)], "o string")
    assert tuple(df.select(A.parse_answer(F.col("o"), labels or spec.ANSWER_LABELS).alias("a")).first()["a"]) == want


def brute_mentions(text, labels):
    """Whole-word search, longest label first, dropping matches inside accepted ones."""
    clean = " ".join(re.findall("[a-z0-9]+", (text or "").lower()))
    taken = []
    for label in sorted(labels, key=len, reverse=True):
        phrase = " ".join(re.findall("[a-z0-9]+", label.lower()))
        for m in re.finditer(rf"\b{phrase}\b", clean):
            if not any(a <= m.start() and m.end() <= b for a, b, _ in taken):
                taken.append((*m.span(), label))
    return sorted(taken)


def test_mentions_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["no", "heart", "disease", "a", "b", "yes,", "Heart", "x-ray", "é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "a b a b a", " ".join(["heart disease"] * 500)]
    for labels in (HEART_LABELS, ["a b a", "a", "b"], ["heart", "disease", "heart disease"], ["positive", "negative"]):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        found = df.select("t", A.label_mentions(F.col("t"), labels).alias("m"), A.parse_answer(F.col("t"), labels)["status"].alias("s"))
        for r in found.collect():
            want = brute_mentions(r["t"], labels)
            assert [tuple(m) for m in r["m"]] == want
            n = len({m[2] for m in want})
            assert r["s"] == ("parsed" if n == 1 else "non_relevant" if n == 0 else "ambiguous")


def test_many_mentions_in_one_text(spark):
    """100,000 mentions: what each of them costs does not grow with their number."""
    labels, text = ["heart", "disease", "heart disease"], " ".join(["heart disease, heart"] * 50_000)
    df = spark.createDataFrame([(text,)], "t string").select(A.label_mentions(F.col("t"), labels).alias("m"))
    found = df.select(F.size("m").alias("n"), F.element_at("m", -1).alias("last"), F.array_distinct(F.transform("m", lambda m: m["label"])).alias("labels")).first()
    size = len("heart disease heart ") * 50_000 - 1
    assert found.n == 100_000 and tuple(found["last"]) == (size - 5, size, "heart") and sorted(found.labels) == ["heart", "heart disease"]


def test_empty_label_is_refused():
    with pytest.raises(ValueError):
        A.label_words("?!")


def responses(spark, counts):
    """Answers from (target, output, n)."""
    rows = [("heart", "m", "json", t, o) for t, o, n in counts for _ in range(n)]
    return spark.createDataFrame(rows, "dataset string, model string, serialization string, target_col string, output string")


YES, NO = "heart disease", "no heart disease"
PUBLISHED_RUNS = [
    ([(YES, "positive", 26), (NO, "positive", 32)], (44.83, 44.83, 100.0, 0.310, 0.0)),
    ([(NO, "positive", 2), (NO, "echo", 30), (YES, None, 26)], (0.0, 0.0, 0.0, 0.0, 96.55)),
    ([(YES, "Positive.", 17), (NO, "positive", 9), (NO, "negative.", 23), (YES, "negative", 9)], (68.97, 65.38, 65.38, 0.686, 0.0)),
    ([(YES, "positive", 3), (NO, "positive", 16), (YES, "", 23), (NO, "", 16)], (5.17, 15.79, 11.54, 0.067, 67.24)),
]


@pytest.mark.parametrize("counts, want", PUBLISHED_RUNS)
def test_published_answer_metrics(spark, counts, want):
    row = evaluate_responses(responses(spark, counts), spec.DATASETS).first()
    got = (100 * row["test_accuracy"], 100 * row["test_precision"], 100 * row["test_recall"])
    assert tuple(round(x, 2) for x in got) == want[:3]
    assert round(row["test_f1_macro"], 3) == want[3] and round(row["invalid_response_pct"], 2) == want[4]
    assert row["test_auc"] is None and row["n_examples"] == 58


def test_answer_confusion_keeps_invalid_answers(spark):
    cells = answer_confusion(responses(spark, PUBLISHED_RUNS[1][0]), spec.DATASETS).collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == 58
    assert {(c["truth"], c["pred"]): c["n"] for c in cells}["positive", "__invalid__"] == 26


def test_unknown_targets_raise(spark):
    with pytest.raises(ValueError, match="maybe"):
        require_known_targets(responses(spark, [("maybe", "x", 1)]), spec.DATASETS)
    require_known_targets(responses(spark, [(YES, "x", 1)]), spec.DATASETS)


def test_display_texts_are_pythons(spark):
    rng = random.Random(9)
    shares = [rng.random() for _ in range(2000)] + [k / 2000 for k in range(2, 2001)] + [k / 16 for k in range(1, 17)] + [k / 58 for k in range(1, 59)]
    df = spark.createDataFrame([(x,) for x in shares], "x double")
    for r in df.select("x", cell_text(F.col("x"), "metric").alias("m"), percent_text(F.col("x")).alias("p")).collect():
        assert (r["m"], r["p"]) == (f"{r['x']:.3f}", f"{r['x']:.1%}")
    times = [rng.random() * 10 ** rng.randint(-6, 9) for _ in range(3000)] + [4.385, 188.368, 0.0625, 999.5, 1225.0, 1235.0, 9.994e-5]
    df = spark.createDataFrame([(x,) for x in times], "x double")
    for r in df.select("x", cell_text(F.col("x"), "time").alias("t")).collect():
        assert r["t"] == f"{r['x']:.3g} s"
    empty = spark.createDataFrame([(None, 0.0, float("nan"))], "a double, b double, c double")
    cells = [cell_text(F.col(c), k) for c, k in (("a", "metric"), ("a", "time"), ("b", "time"), ("c", "metric"))]
    assert tuple(empty.select(*[c.alias(str(i)) for i, c in enumerate(cells)]).first()) == ("-", "-", "0 s", "-")


def test_result_labels(spark):
    rows = [
        ("tabllm", "m", "json", None, "TabLLM: m [json]"),
        ("tabllm", None, None, None, "TabLLM: unknown [unknown]"),
        ("tarte", None, None, "x-y", "TARTE: x-y"),
        ("tarte", None, None, None, "TARTE"),
        ("tabicl_v2", None, None, None, "TabICL v2"),
        ("my_own_model", None, None, None, "My Own Model"),
    ]
    df = spark.createDataFrame(rows, "source string, model string, style string, approach string, want string")
    label = model_label(F.col("source"), F.col("model"), F.col("style"), F.col("approach"))
    for r in df.select("want", label.alias("got")).collect():
        assert r["got"] == r["want"]


def test_no_python_worker_and_no_shuffle_in_row_texts(spark):
    df = spark.range(5).select("id", (F.col("id") / 3).alias("x"), F.col("id").cast("string").alias("s"))
    texts = [X.text_sentences(df.schema.fields), X.text_json(df.schema.fields), A.parse_answer(F.col("s"), HEART_LABELS)]
    plan = df.select(*[t.alias(str(i)) for i, t in enumerate(texts)])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
