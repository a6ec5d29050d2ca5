"""Column expressions on plain text: cleaning, prompts, answers, sentences, token ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.constants import INSTRUCTION_PROMPT

# Blank characters as Python's str.strip() sees them; Java's \s needs (?U) and misses 1c-1f.
_BLANK = r"[\s\x1c-\x1f]"
# Alike in Java regex and RE2, so another engine can check the result.
_SENTENCE = r"[^.!?\n]+[.!?]*"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_unicode(text: Column | str) -> Column:
    """Remove blanks of every kind at both ends, like Python's ``strip``."""
    return F.regexp_replace(as_column(text), rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def newlines_to_blanks(text: Column | str) -> Column:
    return F.replace(as_column(text), F.lit("\n"), F.lit(" "))


def clean_sentence(text: Column | str) -> Column:
    """Remove newlines, a literal ``\\n``, ``""`` and ``" "``, in this order."""
    out = as_column(text)
    for unwanted in ("\n", "\\n", '""', '" "'):
        out = F.replace(out, F.lit(unwanted), F.lit(""))
    return out


def split_sentences(text: Column | str, clean: bool = True) -> Column:
    """Array of sentences: runs up to ``.``, ``!``, ``?`` or a newline, blanks trimmed."""
    found = F.regexp_extract_all(as_column(text), F.lit(_SENTENCE), 0)
    found = F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(found, clean_sentence) if clean else found


def first_element(values: Column | str) -> Column:
    """First array element; null, not an error, when the array is empty."""
    return F.get(as_column(values), F.lit(0))


def render_prompt(
    sentence: Column | str,
    graph: Column | str | None = None,
    template: str = INSTRUCTION_PROMPT,
    eos: str = "",
) -> Column:
    """Fill a template with two ``{}`` slots; without a graph the second stays empty."""
    head, middle, tail = template.split("{}")
    answer = F.lit("") if graph is None else as_column(graph)
    return F.concat(F.lit(head), as_column(sentence), F.lit(middle), answer, F.lit(tail + eos))


def extract_answer(text: Column | str, marker: str) -> Column:
    """Stripped text after the last ``marker``; the whole text when it is absent."""
    return strip_unicode(F.substring_index(as_column(text), marker, -1))


def metadata_id(line: Column | str) -> Column:
    """The id of a ``# ::id`` line: after the last ``::id``, before ``::date``."""
    value = strip_unicode(F.substring_index(as_column(line), "::id", -1))
    return strip_unicode(F.substring_index(value, "::date", 1))


def metadata_sentence(line: Column | str) -> Column:
    return strip_unicode(F.substring_index(as_column(line), "::snt", -1))


def pair_header(sentence: Column | str) -> Column:
    """The ``# ::snt_hu`` line that ties a translation to the graph below it."""
    return F.concat(F.lit("# ::snt_hu "), as_column(sentence))


def op_number(role: Column | str) -> Column:
    """The number of an ``:opN`` role, null when it has none."""
    role = as_column(role)
    return F.substring(role, 4, 1 << 30).try_cast("int")


def pad_or_truncate(ids: Column | str, length: int, pad_id: int = 0) -> Column:
    """Exactly ``length`` ids: cut behind, or filled up with ``pad_id``."""
    filled = F.concat(as_column(ids), F.array_repeat(F.lit(pad_id), length))
    return F.slice(filled, 1, length)


def attention_mask(ids: Column | str, length: int) -> Column:
    """1 for a real id and 0 for padding, exactly ``length`` long."""
    ones = F.transform(as_column(ids), lambda _: F.lit(1))
    return pad_or_truncate(ones, length, 0)


def mask_label_padding(ids: Column | str, pad_id: int = 0, ignore: int = -100) -> Column:
    return F.transform(as_column(ids), lambda x: F.when(x == pad_id, ignore).otherwise(x))


def unmask_label_padding(ids: Column | str, pad_id: int = 0, ignore: int = -100) -> Column:
    return F.transform(as_column(ids), lambda x: F.when(x == ignore, pad_id).otherwise(x))


def completion_of(text: Column | str, response_template: str) -> Column:
    """What follows the last response template; null when the text has none."""
    text = as_column(text)
    tail = F.substring_index(text, response_template, -1)
    return F.when(text.contains(response_template), tail)


def prompt_of(text: Column | str, response_template: str) -> Column:
    """The text up to and including the last response template; all of it when absent."""
    text = as_column(text)
    kept = F.length(text) - F.length(completion_of(text, response_template))
    return F.when(text.contains(response_template), F.substring(text, F.lit(1), kept)).otherwise(text)


def mask_prompt_ids(ids: Column | str, prompt_length: Column | str, ignore: int = -100) -> Column:
    """Labels with the first ``prompt_length`` ids left out of the loss."""
    size = as_column(prompt_length)
    return F.transform(as_column(ids), lambda x, i: F.when(i < size, ignore).otherwise(x))


def completion_labels(ids: Column | str, templates: list[list[int]], ignore: int = -100) -> Column:
    """Labels of ``ids`` with all up to and including the last response template left out of the loss.

    ``templates`` are the ids of the template as it may be cut in different places of a text; the one
    that ends last counts.  Without a template in it a row is left out of the loss as a whole.
    """
    ids = as_column(ids)
    size = F.size(ids)

    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)  # worked out once, however often it is used

    def left(text: Column, template: list[int]) -> Column:
        """Ids behind the last place of the template: blanks behind it; more than all ids without one."""
        tail = F.substring_index(text, f" {' '.join(map(str, template))} ", -1)
        return bound(tail, lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))))

    def least(text: Column) -> Column:
        return F.array_min(F.array(size + 1, *[left(text, t) for t in templates if t]))

    # The search is one of bytes: ids as text, each between blanks.
    blank = F.lit(" ")
    text = F.concat(blank, F.array_join(ids.cast("array<string>"), " ", "_"), blank)
    found = bound(bound(text, least), lambda n: F.when(n > size, F.array_repeat(F.lit(ignore), size)).otherwise(
        F.concat(F.array_repeat(F.lit(ignore), size - n), F.slice(ids, size - n + 1, n))))
    return F.when(size > 0, found).otherwise(ids)
