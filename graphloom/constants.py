"""Texts, markers, names and sizes that users of the data rely on."""

# Prompt templates, filled with sentence and graph.
INSTRUCTION_PROMPT = (
    "### Instruction\n"
    "Provide the AMR graph for the following sentence. Ensure that the graph captures the main "
    "concepts, the relationships between them, and any additional information that is important "
    "for understanding the meaning of the sentence. Use standard AMR notation, including "
    "concepts, roles, and relationships.\n"
    "\n"
    "### Sentence\n"
    "{}\n"
    "\n"
    "### AMR Graph\n"
    "{}"
)
SHORT_PROMPT = "Text: {}\nAMR: {}"

# Text in front of the answer in a model's output.
ANSWER_MARKER = "AMR Graph\n"
ANSWER_HEADING = "### AMR Graph"
SHORT_ANSWER_MARKER = "\nAMR: "

# Split and language names; a lower rank wins a duplicate sentence.
SPLITS = ("training", "dev", "test")
SPLIT_RANK = {"test": 0, "dev": 1, "training": 2}
LANGUAGES = ("HU", "EN")
ALL_LANGUAGES = "ALL"

# Sizes.
BATCH_SIZE = 32
HELD_OUT_OFFSET = 40_000
SAMPLE_SIZE = 50_000
SAMPLE_SEED = 42
ARTICLE_DOMAIN = "index.hu"

# Columns of the scored table.
SCORE_F1 = "smatchpp_f1"
SCORE_PRECISION = "smatchpp_prec"
SCORE_RECALL = "smatchpp_rec"
PARSABLE = "parsable"

# Texts a CSV reader takes as missing (the pandas defaults).
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
