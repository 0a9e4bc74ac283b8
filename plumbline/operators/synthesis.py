"""Adversarial and synthetic rows: perturbations, templates, parsing and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.keyed import pick, uniform
from plumbline.operators.augment import _salted, _strings
from plumbline.operators.scoring import GENERIC, STOP_WORDS
from plumbline.operators.splitting import curriculum_order
from plumbline.plans.ordering import ranked

# Perturbation texts.
NEGATIONS = ["not", "never", "no", "none", "neither"]
PARAPHRASES = [
    ("In other words, ", ""), ("To put it differently, ", ""), ("Essentially, ", ""),
    ("What I mean is, ", ""), ("", " - that is to say..."),
]
DISTRACTORS = [
    "(though this may not be relevant)", "- and by the way, here's some additional context:",
    "Consider also that", "It's worth noting, although unrelated,", "As a tangent,",
]
NOISE = [
    "the weather has been unusual lately", "many people have different opinions on this",
    "there are multiple perspectives to consider", "the historical context is quite interesting",
]
AMBIGUITY = ["maybe", "perhaps", "possibly", "it could be that", "in some cases", "depending on the interpretation"]
COMPLEXITY = [
    ("Given that ", ", and considering all edge cases,"), ("If we assume ", ", and also account for exceptions,"),
    ("Taking into account multiple factors, ", ", specifically"), ("In the context of ", ", with all constraints applied,"),
]
# Probes per weakness (query, expected answer).
WEAKNESSES = {
    "logic_errors": [
        ("If A implies B, and B implies C, does A imply C?", "Yes, by transitivity of implication."),
        ("All X are Y. Z is not Y. Is Z an X?", "No, Z cannot be X since all X are Y but Z is not Y."),
    ],
    "math_errors": [("What is 15% of 80?", "12"), ("If x + 5 = 12, what is x?", "7")],
    "factual_errors": [("What is the capital of France?", "Paris")],
    "context_misuse": [
        (
            "Given the context about cats, what color is the sky?",
            "The provided context about cats does not contain information about sky color.",
        )
    ],
    "hallucination": [
        (
            "What did Albert Einstein say about quantum computing in his 1905 papers?",
            "Einstein did not discuss quantum computing in 1905; quantum computing was theorized much later.",
        )
    ],
}
# Edge-case probes (query, kind).
EDGE_CASES = [
    ("", "empty_input"), ("?", "minimal_input"), ("   ", "whitespace_only"), ("word " * 500, "long_input"),
    ("What is <script>alert('test')</script>?", "injection"), ("Tell me about $$$^^^***", "special_chars"),
    ("Give me a short but comprehensive explanation", "contradiction"),
    ("Explain in English pero también en español", "multilingual"),
]
# Task templates (id, instruction, input, output) and the words that fill them.
TEMPLATES = {
    ("reasoning", "easy"): [
        (
            "reasoning_easy_1", "Explain why {concept} is important.", "",
            "This concept is important because it provides foundational understanding for building more complex systems and solving real-world problems.",
        ),
        (
            "reasoning_easy_2", "What are three benefits of {concept}?", "",
            "Three key benefits are: 1) Improved efficiency in processing data, 2) Better accuracy in predictions, and 3) Scalability for large-scale applications.",
        ),
    ],
    ("reasoning", "medium"): [
        (
            "reasoning_medium_1", "Compare and contrast two approaches to {concept}.", "",
            "When comparing different approaches, we need to consider factors like performance, complexity, and use cases. Each approach has trade-offs depending on the specific requirements.",
        )
    ],
    ("reasoning", "hard"): [
        (
            "reasoning_hard_1", "Design a system that leverages {concept} for solving complex optimization problems.",
            "Consider scalability and real-time requirements.",
            "A robust system design would incorporate multiple layers: data ingestion, processing pipeline, optimization engine, and monitoring. Key considerations include fault tolerance, horizontal scaling, and latency requirements.",
        )
    ],
    ("code", "easy"): [
        (
            "code_easy_1", "Write a function to calculate the factorial of a number in {language}.", "",
            "def factorial(n):\n    if n <= 1:\n        return 1\n    return n * factorial(n - 1)",
        )
    ],
    ("code", "medium"): [
        (
            "code_medium_1", "Implement a binary search algorithm in {language}.", "",
            "def binary_search(arr, target):\n    left, right = 0, len(arr) - 1\n    while left <= right:\n        mid = (left + right) // 2\n        if arr[mid] == target:\n            return mid\n        elif arr[mid] < target:\n            left = mid + 1\n        else:\n            right = mid - 1\n    return -1",
        )
    ],
}
FILL = {
    "{concept}": ["machine learning", "neural networks", "deep learning", "natural language processing", "computer vision"],
    "{language}": ["Python", "JavaScript", "TypeScript", "Rust", "Go"],
    "{topic}": ["algorithms", "data structures", "system design", "testing", "debugging"],
}
MIX = {"easy": 0.3, "medium": 0.4, "hard": 0.3}


def _wrap(row_id, text, op, pairs, copy):
    k = pick(row_id, op, len(pairs), copy) + 1
    return F.concat(F.element_at(_strings([p[0] for p in pairs]), k), text, F.element_at(_strings([p[1] for p in pairs]), k))


def negation(row_id: Column, text: Column, copy: int | Column = 0) -> Column:
    """Insert 'not' unless present, or drop the negating words; a keyed coin decides."""
    ws = X.words(text)
    at = pick(row_id, "negpos", F.greatest(F.lit(1), F.size(ws) - 1), copy) + 1
    added = F.concat(F.slice(ws, F.lit(1), at), F.array(F.lit("not")), F.slice(ws, at + 1, F.size(ws)))
    has = F.lower(text).contains("not")
    dropped = F.filter(ws, lambda w: ~F.array_contains(_strings(NEGATIONS), F.lower(w)))
    grow = F.when(has, F.array_join(ws, " ")).otherwise(F.array_join(added, " "))
    return F.when(uniform(row_id, "negcoin", copy) > 0.5, grow).otherwise(F.array_join(dropped, " "))


def paraphrase(row_id: Column, text: Column, copy: int | Column = 0) -> Column:
    return _wrap(row_id, text, "para", PARAPHRASES, copy)


def distractor(row_id: Column, text: Column, copy: int | Column = 0) -> Column:
    d = F.element_at(_strings(DISTRACTORS), pick(row_id, "distract", len(DISTRACTORS), copy) + 1)
    n = F.element_at(_strings(NOISE), pick(row_id, "noise", len(NOISE), copy) + 1)
    return F.concat_ws(" ", text, d, n)


def ambiguity(row_id: Column, text: Column, copy: int | Column = 0) -> Column:
    ws = X.words(text)
    at = pick(row_id, "ambpos", F.size(ws) + 1, copy)
    word = F.element_at(_strings(AMBIGUITY), pick(row_id, "ambword", len(AMBIGUITY), copy) + 1)
    return F.array_join(F.concat(F.slice(ws, F.lit(1), at), F.array(word), F.slice(ws, at + 1, F.size(ws) + 1)), " ")


def complexity(row_id: Column, text: Column, copy: int | Column = 0) -> Column:
    return _wrap(row_id, text, "complex", COMPLEXITY, copy)


PERTURBATIONS = {
    "negation": negation, "paraphrase": paraphrase, "distractor": distractor, "ambiguity": ambiguity, "complexity": complexity,
}


def perturb_compose(df: DataFrame, row_id: str, field: str, k: int = 1, copy: str | None = None) -> DataFrame:
    """Apply k distinct perturbations in keyed order: those with the smallest draws."""
    c = F.col(copy) if copy else F.lit(0)
    draws = [F.struct(uniform(F.col(row_id), f"order-{n}", c).alias("u"), F.lit(n).alias("n")) for n in PERTURBATIONS]
    order = F.transform(F.slice(F.sort_array(F.array(*draws)), 1, k), lambda s: s["n"])
    d = df.withColumn("applied", order)
    for i in range(k):
        text = F.col(field)
        for n, fn in PERTURBATIONS.items():
            text = F.when(F.col("applied")[i] == n, fn(F.col(row_id), F.col(field), _salted(F.lit(i), c))).otherwise(text)
        d = d.withColumn(field, text)
    return d


def from_weakness(ids: DataFrame, row_id: str, weakness: str, difficulty: str = "medium") -> DataFrame:
    """One probe per id; easy stays as it is, medium gets one perturbation, hard two."""
    probes = WEAKNESSES.get(weakness, [])
    if not probes:
        return ids.select(row_id, *[F.lit("").alias(c) for c in ("original", "query", "expected")]).where(F.lit(False))
    k = pick(F.col(row_id), "weak", len(probes)) + 1
    d = ids.select(row_id, F.element_at(_strings([p[0] for p in probes]), k).alias("original"), F.element_at(_strings([p[1] for p in probes]), k).alias("expected"))
    d = d.withColumn("query", F.col("original"))
    times = {"easy": 0, "medium": 1, "hard": 2}[difficulty]
    return perturb_compose(d, row_id, "query", times).drop("applied") if times else d


def from_failures(failures: DataFrame, row_id: str, field: str, n: int = 5) -> DataFrame:
    c = failures.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("original_query", F.col(field))
    p = perturb_compose(c, row_id, field, 1, "copy")
    return p.withColumns(
        {"expected_output": F.lit(""), "target_weakness": F.lit("failure_pattern"), "difficulty": F.lit("hard"), "perturbation_type": F.lit("failure_based")}
    )


def edge_cases(domains: DataFrame, domain: str, n: int = 20) -> DataFrame:
    """The first n fixed probes for every domain."""
    rows = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(q).alias("query"), F.lit(k).alias("kind")) for i, (q, k) in enumerate(EDGE_CASES[:n])])
    return domains.select(domain).distinct().select(domain, F.inline(rows))


def escalate(df: DataFrame, row_id: str, field: str, target: str = "hard") -> DataFrame:
    d = perturb_compose(df.withColumn("__new", F.col(field)), row_id, "__new", 2)
    raise_it = F.col("difficulty") != target
    return d.withColumns(
        {
            field: F.when(raise_it, F.col("__new")).otherwise(F.col(field)),
            "perturbation_type": F.when(raise_it, F.concat(F.lit("escalated_"), "perturbation_type")).otherwise(F.col("perturbation_type")),
            "difficulty": F.lit(target),
        }
    ).drop("__new", "applied")


def _filled(text: Column, row_id: Column) -> Column:
    for mark, options in FILL.items():
        word = F.element_at(_strings(options), pick(row_id, "fill" + mark, len(options)) + 1)
        text = F.replace(text, F.lit(mark), word)
    return F.replace(text, F.lit("{number}"), (pick(row_id, "fill{number}", 100) + 1).cast("string"))


def template_rows(ids: DataFrame, row_id: str, task: str, difficulty: str) -> DataFrame:
    """One filled template per id; a task without templates gives no rows."""
    rows = TEMPLATES.get((task, difficulty), [])
    if not rows:
        blank = [F.lit("").alias(c) for c in ("template_id", "instruction", "input", "output", "difficulty")]
        return ids.select(row_id, *blank).where(F.lit(False))
    k = pick(F.col(row_id), "template", len(rows)) + 1
    part = lambda j: F.element_at(_strings([r[j] for r in rows]), k)
    i = F.col(row_id)
    return ids.select(
        row_id, part(0).alias("template_id"), _filled(part(1), i).alias("instruction"), _filled(part(2), i).alias("input"),
        part(3).alias("output"), F.lit(difficulty).alias("difficulty"),
    )


def parse_generated(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Rows of a JSON list, fenced or bare; broken JSON gives none, a missing key ''."""
    fenced = F.regexp_extract(text, r"(?s)```json\n(.*?)\n```", 1)
    body = F.when(F.col(text).contains("```json\n") & (fenced != ""), fenced).otherwise(F.col(text))
    parsed = F.from_json(body, "array<struct<instruction:string,input:string,output:string>>", {"mode": "PERMISSIVE"})
    # a broken document parses to a list without any field set
    rows = df.select(*keep, F.posexplode(parsed).alias("pos", "r"))
    r = rows.select(*keep, "pos", *[F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("instruction", "input", "output")], F.col("r").isNull().alias("__bad"))
    return r.where(~F.col("__bad")).drop("__bad")


def synthetic_score(instr: Column, out: Column) -> Column:
    """Score in tenths: lengths 2 + 2, overlap of two content words 3, informative 3."""
    overlap = X.word_overlap(instr, out, STOP_WORDS) >= 2
    sentence = F.size(F.filter(F.split(out, r"\."), lambda s: s.rlike(X.INK))) >= 1
    informative = ~X.any_phrase(F.lower(out), GENERIC) & sentence
    n, m = F.length(instr), F.length(out)
    one = lambda c, v: F.when(c, v).otherwise(0)
    return one((n > 10) & (n < 500), 2) + one((m > 20) & (m < 3000), 2) + one(overlap, 3) + one(informative, 3)


def validate_synthetic(df: DataFrame, row_id: str, n: int | None = None) -> DataFrame:
    """Keep score >= 0.5, best first; at most n rows when n is given."""
    s = df.withColumn("tenths", synthetic_score(F.col("instruction"), F.col("output"))).where("tenths >= 5")
    s = s.withColumn("validation_score", F.col("tenths") / 10.0)
    return s if n is None else s.orderBy(F.desc("tenths"), row_id).limit(n)


def curriculum_mix(ids: DataFrame, row_id: str, task: str, mix: dict[str, float] | None = None) -> DataFrame:
    """int(total*share) template rows per level, in level order with a position."""
    r = ranked(ids.select(row_id), [row_id], name="__rank")
    total = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    r = r.withColumn("__n", total)
    lo, out = F.lit(0).cast("bigint"), None
    for level, share in (mix or MIX).items():
        hi = lo + F.floor(F.col("__n") * F.lit(share))
        part = template_rows(r.where((F.col("__rank") > lo) & (F.col("__rank") <= hi)), row_id, task, level)
        out = part if out is None else out.unionByName(part)
        lo = hi
    return curriculum_order(out, "difficulty", row_id)


def cross_model_agreement(examples: DataFrame, verdicts: DataFrame, row_id: str, threshold: float = 0.7) -> DataFrame:
    """Share of validators that call a row valid; a row without verdicts is valid."""
    a = verdicts.groupBy(row_id).agg(F.avg(F.col("valid").cast("double")).alias("agreement"))
    return examples.join(a, row_id, "left").withColumn("valid", F.coalesce(F.col("agreement") >= threshold, F.lit(True)))


