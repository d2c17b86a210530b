"""Model-backed operators: extraction, generation, distractors, verification, scoring, merging and enrichment.

Each is one ``Task``: rows are dealt into batches in order, a batch makes one prompt that lists its items as
JSON, the answers are stored raw, and a projection parses them. Elements of an answer name their item by
``index`` (from 1), so a short or broken answer never shifts what belongs to other items; without an
index the place counts. Items without an answer come back with ``answered`` false.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learngraph.functions import text as T
from learngraph.functions.responses import response_rows
from learngraph.operators import quality
from learngraph.operators.export import DEFAULTS, shuffled_options
from learngraph.shared import written
from learngraph.sources.budget import Budget, call_within
from learngraph.sources.connectors import call

ITEMS = "ITEMS:\n"


@dataclass(frozen=True)
class Task:
    name: str
    asks: str  # what the model is told, in our own words
    fields: str  # DDL of an answer's element, besides index
    size: int
    temperature: float
    many: bool = False  # several elements for one item
    whole: bool = False  # an answer of another length than its batch counts as none


EXTRACT = Task("extract", "From each section, list every self-sufficient statement worth learning, with its kind and the concepts it is about.", "type STRING, statement STRING, concepts ARRAY<STRING>", 3, 0.2, many=True)
GENERATE = Task("generate", "For each unit write one question that can be answered without its source, the answer, and a hint that doesn't give it away.", "question STRING, answer STRING, expected_output STRING, hint STRING", 5, 0.3)
# What to ask of a unit of each type.
ASKS = {
    "definition": "Ask what the term means or which term fits the description.",
    "theorem": "Ask what follows, and under which conditions it holds.",
    "rule": "Ask when the rule applies and what it demands.",
    "constraint": "Ask what is not allowed or what limit there is, and why.",
    "property": "Ask which property it is or what has it.",
    "fact": "Ask for the fact itself, in words that leave one answer.",
    "algorithm_step": "Ask what is done in this step and what comes of it; where the answer is code, give its output too.",
    "example": "Ask what the example shows, without repeating it.",
}
DISTRACT = Task("distract", "For each question write three wrong answers that someone who half understood could give.", "distractors ARRAY<STRING>", 5, 0.4)
VERIFY = Task("verify", "For each pair say whether knowing the first is needed for the second, and how sure you are (high, medium, low).", "is_prerequisite BOOLEAN, confidence STRING", 10, 0.0)
EVALUATE = Task("evaluate", "Score each question from 1 to 5 for faithfulness to its source, clarity, and where present its hint and wrong answers; say yes or no whether it is atomic and self-contained.", "faithfulness INT, question_clarity INT, hint_quality INT, distractor_plausibility INT, atomic STRING, self_contained STRING", 8, 0.0)
ENRICH = Task("enrich", "For each question give a short name and the seconds needed to answer and to explain it.", "generated_name STRING, time_to_handle INT, time_to_explain INT", 10, 0.3, whole=True)
MERGE = Task("merge", "Both statements of each pair say the same: write the one statement that keeps all they hold.", "type STRING, statement STRING", 1, 0.0)


def single(task: Task) -> Task:
    """The task for one item a prompt."""
    return replace(task, size=1)


def prompts(dealt: DataFrame, task: Task, payload: list[str], model: str | None) -> DataFrame:
    """batch, model and messages of rows that carry batch and pos."""
    system = f"TASK {task.name}. {task.asks} Answer with a JSON array only; each element has the item's index (from 1) and: {task.fields}."
    item = F.struct((F.col("pos") + 1).alias("index"), *[F.col(c) for c in payload])
    lists = dealt.groupBy("batch").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))), lambda s: s["x"])).alias("items"))
    users = F.struct(F.lit("user").alias("role"), F.concat(F.lit(ITEMS), "items").alias("content"))
    messages = F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), users))
    return lists.select("batch", F.lit(model).cast("string").alias("model"), messages.alias("messages"))


def answers(raw: DataFrame, task: Task) -> DataFrame:
    """batch, pos and the fields of every element that parses, the first of an index only unless the task has many."""
    named = {f.split()[0] for f in task.fields.split(", ")}
    found = raw.where("status = 'ok'").select("batch", response_rows(F.col("response")).alias("r"))
    each = found.select("batch", F.size("r").alias("n"), F.posexplode("r").alias("place", "j")).withColumn("a", F.from_json("j", f"index INT, {task.fields}")).where("a IS NOT NULL")
    out = each.select("batch", "n", "place", F.coalesce(F.col("a.index") - 1, "place").alias("pos"), *[F.col(f"a.{c}") for c in sorted(named)])
    if task.many:
        return out
    rest = [c for c in out.columns if c not in ("batch", "pos")]
    firsts = out.groupBy("batch", "pos").agg(F.min_by(F.struct(*rest), "place").alias("s"))
    return firsts.select("batch", "pos", "s.*")


def ask(items: DataFrame, task: Task, client: Callable[[], Callable], payload: list[str], *, order: str = "seq", model: str | None = None, replay: DataFrame | None = None, budget: Budget | None = None) -> tuple[DataFrame, DataFrame]:
    """Items with the answer's fields and ``answered``, and the raw answers to keep for replays.

    Fields of the items that the answer has too are replaced. Raw answers are written before they
    are parsed, so no task that is run again asks again. With a ``budget``, calls keep it over the whole cluster.
    """
    dealt = written(quality.batches(items, task.size, order), "dealt")
    asked = prompts(dealt, task, payload, model)
    told = call_within(asked, client, budget, temperature=task.temperature, replay=replay)[0] if budget else call(asked, client, temperature=task.temperature, replay=replay)
    raw = written(told, "raw")
    found = answers(raw, task)
    if task.whole:
        sizes = dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("wanted"))
        found = found.join(sizes, "batch").where("n = wanted").drop("wanted")
    found = (found.drop("n") if task.many else found.drop("n", "place")).withColumn("answered", F.lit(True))
    own = dealt.drop(*[c for c in found.columns if c not in ("batch", "pos")])
    joined = own.join(found, ["batch", "pos"], "inner" if task.many else "left").drop("batch", "pos")
    return joined.withColumn("answered", F.coalesce("answered", F.lit(False))), raw


def extract_units(sections: DataFrame, client, *, places: bool = False, **how) -> DataFrame:
    """Atomic units of sections (seq, page, source, content), each with its own section's provenance and a known type; with their place in the answer, if asked for."""
    found, _ = ask(sections, EXTRACT, client, ["content"], **how)
    kept = found.where(T.truthy(F.col("statement")))
    return kept.select("seq", T.coerce_type(F.col("type")).alias("type"), "statement", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"), F.col("source").alias("source_title"), F.col("page").alias("source_page"), *(["place"] if places else []))


def generate_by_type(units: DataFrame, client, **how) -> DataFrame:
    """``generate_objects`` with prompts of one type of unit each, which say what to ask of that type."""
    out = None
    for kind, asks in ASKS.items():
        made = generate_objects(units.where(F.col("type") == kind), client, task=replace(GENERATE, asks=f"{GENERATE.asks} {asks}"), **how)
        out = made if out is None else out.unionByName(made)
    return out


def generate_objects(units: DataFrame, client, *, task: Task = GENERATE, **how) -> DataFrame:
    """Learning objects of units (seq, type, statement, source_title, source_page): with id, keywords and provenance in the hint; only those that were answered."""
    named = units.withColumn("id", T.object_id(F.col("statement")))  # before the answers come, so that statements only travel to them where they are read afterwards
    found, _ = ask(named, task, client, ["type", "statement"], **how)
    made = found.where("answered").drop("answered")
    hint = T.with_provenance(F.col("hint"), F.col("source_title"), F.col("source_page"))
    return made.withColumns({"source_statement": F.col("statement"), "keywords": T.keywords(T.question_and_answer(F.col("question"), F.col("answer"))), "hint": hint})


def add_choices(objects: DataFrame, client, **how) -> DataFrame:
    """Objects with mc_options and mc_correct_index where their type allows them and three distractors came; others unchanged."""
    bare = objects.drop("mc_options", "mc_correct_index")
    allowed = T.allows_choices(F.col("type"))
    found, _ = ask(bare.where(allowed), DISTRACT, client, ["question", "answer"], **how)
    chosen = shuffled_options(found.withColumn("distractors", F.coalesce("distractors", F.array().cast("array<string>")))).drop("distractors", "answered")
    return chosen.unionByName(bare.where(~F.coalesce(allowed, F.lit(False))), allowMissingColumns=True)


def verify_edges(edges: DataFrame, objects: DataFrame, client, **how) -> DataFrame:
    """Edges (src, dst) that the model calls prerequisites with high or medium confidence. Of objects with one id, the last counts."""
    texts = quality.last_by_key(objects.select("id", "seq", "question", "answer"), ["id"], "seq")
    side = lambda name: texts.select(F.col("id").alias(name), F.to_json(F.struct("question", "answer")).alias(f"{name}_text"))
    known = edges.select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), "dst").withColumn("seq", F.concat_ws("\0", "src", "dst"))
    found, _ = ask(known, VERIFY, client, ["src_text", "dst_text"], **how)
    return found.where("answered AND is_prerequisite AND confidence IN ('high', 'medium')").select("src", "dst", "confidence")


def evaluate(objects: DataFrame, models: list[str], client, *, attempt: int = 0, sizes: dict[str, int] | None = None, **how) -> DataFrame:
    """One row per object and model that answered. Hints and choices are judged only where there are any."""
    out = None
    has_hint = F.coalesce(F.length(F.trim("hint")) > 0, F.lit(False))
    has_choices = F.coalesce(F.size("mc_options") > 0, F.lit(False)) if "mc_options" in objects.columns else F.lit(False)
    shown = objects.select("id", "seq", *[T.truncate(F.col(c)).alias(c) for c in ("question", "answer", "hint", "source_statement")], has_hint.alias("has_hint"), has_choices.alias("has_choices"))
    for model in models:
        task = replace(EVALUATE, size=(sizes or {}).get(model, EVALUATE.size))
        found, _ = ask(shown, task, client, ["question", "answer", "hint", "source_statement", "has_hint", "has_choices"], model=model, **how)
        scored = found.where("answered").select(
            F.col("id").alias("lo_id"), F.lit(model).alias("model"), F.lit(attempt).alias("attempt"), "faithfulness", "question_clarity", F.when(F.col("has_hint"), F.col("hint_quality")).alias("hint_quality"),
            F.when(F.col("has_choices"), F.col("distractor_plausibility")).alias("distractor_plausibility"), "atomic", "self_contained",
        )
        out = scored if out is None else out.unionByName(scored)
    return out


def evaluate_missing(objects: DataFrame, models: list[str], client, evaluations: DataFrame, *, rounds: int = 3, **how) -> DataFrame:
    """Evaluations with those of further rounds for objects that some model left out."""
    done = evaluations
    for _ in range(rounds):
        missing = written(quality.missing_evaluations(objects, models, done), "missing")
        if missing.isEmpty():
            break
        for model in models:
            todo = objects.join(missing.where(F.col("model") == model).select(F.col("lo_id").alias("id")), "id", "left_semi")
            done = done.unionByName(evaluate(todo, [model], client, **how))
        done = written(done, "evaluations")
    return done


def filter_and_regenerate(objects: DataFrame, units: DataFrame, models: list[str], client, *, faithfulness: float = 3.0, hint_quality: float = 2.0, attempts: int = 2, accumulate: bool = False) -> tuple[DataFrame, DataFrame]:
    """Objects after at most ``attempts`` rounds of evaluation and regeneration, and all evaluations.

    A round scores what is new, fails objects by consensus or by a question that leans on something outside,
    and writes failing ones anew from their unit (of units with one statement, the last). Columns added:
    evaluated (false for what the last round wrote) and regen_status (null, regenerated, or unmatched: no
    unit, or no answer; such objects are kept as they are). Choices are made again for regenerated objects.
    ``accumulate`` judges by all attempts' scores instead of the last's.
    """
    # Statements stay where they are written; objects carry their names and what of them is shown to judges.
    named = lambda df, c: df.withColumn("_named", F.unhex(F.sha2(F.col(c).cast("binary"), 256)))
    brief = lambda df, c: df.withColumn("_shown", T.truncate(F.col(c)))
    first = written(named(objects.drop("evaluated", "regen_status").withColumns({"evaluated": F.lit(False), "regen_status": F.lit(None).cast("string")}), "source_statement"), "objects")
    sources = written(named(units, "statement"), "units")
    columns = [c for c in first.columns if c != "_named"]
    held = brief(first, "source_statement").drop("source_statement")
    todo, scores = held, None
    for attempt in range(attempts):
        new = written(evaluate(todo.withColumnRenamed("_shown", "source_statement"), models, client, attempt=attempt), "evaluations")
        scores = new if scores is None else scores.unionByName(new)
        judged = quality.consensus(quality.latest(scores, accumulate), faithfulness, hint_quality)
        bad = quality.failing(judged).select(F.col("lo_id").alias("id"))
        leaning = held.where(T.outside_reference(F.col("question")).isNotNull()).select("id")
        failed = written(bad.unionByName(leaning).distinct(), "failed")
        held = held.withColumn("evaluated", F.lit(True))
        if failed.isEmpty():
            break
        matched = held.join(failed, "id", "left_semi").select("_named").distinct()
        lost = quality.last_by_key(sources.where("statement IS NOT NULL").join(matched, "_named", "left_semi"), ["_named"], "seq")
        again = generate_objects(brief(lost, "statement"), client).drop("source_statement")
        again = again if "statement" in columns else again.drop("statement")
        again = written(add_choices(again, client), "again").withColumns({"evaluated": F.lit(False), "regen_status": F.lit("regenerated")})
        fresh = again.join(failed, "id", "left_semi")
        unmatched = failed.join(again.select("id"), "id", "left_anti").withColumn("_unmatched", F.lit(True))
        kept = held.join(fresh.select("id"), "id", "left_anti").join(unmatched, "id", "left")
        kept = kept.withColumn("regen_status", F.when(F.col("_unmatched"), "unmatched").otherwise(F.col("regen_status")))
        # Not written: what is written are the objects at first, and each round's failures and new ones.
        held = kept.drop("_unmatched").unionByName(fresh, allowMissingColumns=True).select(held.columns)
        todo = quality.to_evaluate_again(held, fresh, "id")
    texts = first.groupBy("_named").agg(F.first("source_statement").alias("source_statement"))
    return held.join(texts, "_named", "left").select(columns), scores


def merge_units(pairs: DataFrame, units: DataFrame, client, **how) -> DataFrame:
    """The merged unit of each pair (a, b) of seq: the model's statement (a's, where it fails), both units' concepts, a's provenance and then b's."""
    side = lambda k: units.select(F.col("seq").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("type", "statement", "concepts", "source_title", "source_page")])
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").withColumn("seq", F.col("a"))
    found, _ = ask(both, MERGE, client, ["a_statement", "b_statement"], **how)
    good = F.col("answered") & T.truthy(F.col("statement"))
    return found.select(
        "seq", F.when(good, T.coerce_type(F.col("type"))).otherwise(F.col("a_type")).alias("type"), F.when(good, F.col("statement")).otherwise(F.col("a_statement")).alias("statement"),
        F.array_union("a_concepts", "b_concepts").alias("concepts"), F.coalesce("a_source_title", "b_source_title").alias("source_title"), F.coalesce("a_source_page", "b_source_page").alias("source_page"),
    )


def merge_similar(units: DataFrame, embed: Callable[[DataFrame], DataFrame], client, *, threshold: float = 0.9, passes: int = 10) -> DataFrame:
    """Units after passes of pairing (in order, each unit once a pass) and merging, until no pair is left."""
    from learngraph.operators.vectors import greedy_matching, similar_pairs

    held = written(units.select("seq", "type", "statement", "concepts", "source_title", "source_page"), "units")
    for _ in range(passes):
        pairs = greedy_matching(similar_pairs(embed(held).select("seq", "vector"), threshold, id_col="seq", vector_col="vector"))
        if pairs.isEmpty():
            break
        gone = pairs.select(F.explode(F.array("a", "b")).alias("seq"))
        held = written(held.join(gone, "seq", "left_anti").unionByName(merge_units(pairs, held, client)), "units")
    return held


def enrich(objects: DataFrame, client, **how) -> DataFrame:
    """Objects with name and times; defaults for a whole batch whose answer has another length than the batch."""
    found, _ = ask(objects, ENRICH, client, ["question", "answer"], **how)
    return found.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in DEFAULTS.items()}).drop("answered")


def _titled(text: str) -> str:
    """Each run of letters, or of other characters, with its first one large and the rest small, one for one (``str.title`` makes two of some)."""
    upper = lambda c: c.upper() if len(c.upper()) == 1 else "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c
    lower = lambda c: c.lower() if len(c.lower()) == 1 else c.lower()[0]
    return "".join((lower if k and text[k - 1].isalpha() == c.isalpha() else upper)(c) for k, c in enumerate(text))


def stub_client() -> Callable[[list[dict], str | None, float], str]:
    """A deterministic client: its answers follow from the items alone."""

    def answer(messages: list[dict], model: str | None, temperature: float) -> str:
        task = messages[0]["content"].split(".")[0].removeprefix("TASK ")
        items = json.loads(messages[-1]["content"].removeprefix(ITEMS))
        out = []
        for x in items:
            text = " ".join(str(v) for k, v in sorted(x.items()) if k != "index")
            words = [w for w in dict.fromkeys(text.split()) if len(w) > 2] or ["it"]
            weight = sum(map(ord, (model or "") + text)) % 5
            made = {
                "extract": {"type": "fact", "statement": " ".join(words[:12]), "concepts": words[:3]},
                "generate": {"question": f"What is said of {words[0]}?", "answer": " ".join(words[:6]), "hint": f"Think of {words[-1]}..."},
                "distract": {"distractors": [f"{w} not" for w in (words * 3)[:3 + weight % 2]]},
                "verify": {"is_prerequisite": weight > 1, "confidence": ["high", "medium", "low"][weight % 3]},
                "evaluate": {"faithfulness": 1 + weight, "question_clarity": 4, "hint_quality": 1 + weight % 4, "distractor_plausibility": 3, "atomic": "no" if weight == 0 else "yes", "self_contained": "yes"},
                "enrich": {"generated_name": _titled(" ".join(words[:3])), "time_to_handle": 30 + weight, "time_to_explain": 20},
                "merge": {"type": "fact", "statement": " ".join(words[:20])},
            }[task]
            out.append({"index": x["index"], **made})
        return "```json\n" + json.dumps(out, ensure_ascii=False) + "\n```"

    return answer
