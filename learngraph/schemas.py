"""Entity schemas and fixed vocabularies of the knowledge base."""

from __future__ import annotations

# Fixed values.
UNIT_TYPES = ("definition", "theorem", "rule", "constraint", "property", "fact", "algorithm_step", "example")
DEFAULT_TYPE = "fact"
LAYERS = {"definition": 1, "theorem": 1, "rule": 2, "constraint": 2, "property": 3, "fact": 3, "algorithm_step": 4, "example": 5}
DEFAULT_LAYER = 3
CHOICE_TYPES = tuple(t for t in UNIT_TYPES if t not in ("algorithm_step", "example"))

# English function words, by kind: our own list of what keyword extraction and concept normalisation leave out.
ARTICLES = "a an the this that these those some any each every either neither both all another such no"
PRONOUNS = (
    "i me my mine myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "one oneself who whom whose which what whoever whatever something anything nothing everything someone anyone everyone"
)
PREPOSITIONS = (
    "about above across after against along among around as at before behind below beneath beside between beyond by despite down during except for from in inside into like near of off on onto out "
    "outside over past per since through throughout to toward towards under until up upon via with within without"
)
CONJUNCTIONS = "and or but nor so yet if then else than because while whereas although though unless whether"
AUXILIARIES = "am is are was were be been being do does did doing done have has had having can could may might must shall should will would ought cannot"
ADVERBS = "not only just very too also again once here there where when why how now ever never always often more most less least much many few several own same other quite rather almost even still already"
# Contractions fall into two tokens at the apostrophe: an auxiliary with the n of "not" (three change before it), and what stands behind it.
NEGATED = "is are was were has have had do does did could might must should would need"
CONTRACTIONS = " ".join([*(w + "n" for w in NEGATED.split()), "ain shan won", "d ll m re s t ve"])
STOPWORDS = tuple(sorted(set(" ".join((ARTICLES, PRONOUNS, PREPOSITIONS, CONJUNCTIONS, AUXILIARIES, ADVERBS, CONTRACTIONS)).split())))

SECTION = "seq BIGINT, page INT, source STRING, content STRING"
ATOMIC_UNIT = "seq BIGINT, type STRING, statement STRING, concepts ARRAY<STRING>, normalized_concepts ARRAY<STRING>, source_title STRING, source_page INT"
LEARNING_OBJECT = (
    "seq BIGINT, id STRING, type STRING, question STRING, answer STRING, expected_output STRING, hint STRING, source_statement STRING, keywords ARRAY<STRING>, "
    "source_title STRING, source_page INT, mc_options ARRAY<STRING>, mc_correct_index INT, anchor STRING, prerequisite_ids ARRAY<STRING>, lexical_overlap DOUBLE, "
    "semantic_similarity DOUBLE, generated_name STRING, time_to_handle INT, time_to_explain INT"
)
# The union of all rubrics: a score that a rubric lacks is null.
EVALUATION = (
    "lo_id STRING, model STRING, attempt INT, faithfulness INT, clarity INT, question_clarity INT, hint_quality INT, pedagogical_value INT, "
    "distractor_plausibility INT, hallucination_detected STRING, atomic STRING, self_contained STRING, answer_grounded STRING, justification STRING"
)
CONCEPT_EDGE = "src STRING, dst STRING, weight BIGINT"
EXPORT = (
    "units ARRAY<STRUCT<title: STRING, description: STRING, questions: ARRAY<STRUCT<name: STRING, description: STRING, type: STRING, time_to_handle: INT, "
    "time_to_explain: INT, hints: ARRAY<STRUCT<name: STRING, url: STRING>>, choices: ARRAY<STRUCT<text: STRING, is_correct: BOOLEAN>>>>>>"
)
