"""Column expressions for raw model answers, transcripts and ids.

All of them are JVM-side but for the edit distance of word lists, which comes
to Python in Arrow batches.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a score looks like
NUMBER = r"[-+]?(?:\d+\.\d+|\d+)"
NUMERIC_KINDS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
CHOICE_KEYS = ("choice", "answer", "synthetic", "synthetic_audio")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Column functions that use an argument several times would otherwise copy
    its whole expression each time.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def within(value: Column, low, high) -> Column:
    """``value`` where it lies on the scale, else null."""
    return F.when(value.between(low, high), value)


def as_number(text: Column) -> Column:
    return text.try_cast("double")


def first_number(text: Column, low, high) -> Column:
    """The first number of a text, if it is on the scale; later ones don't count."""
    return within(as_number(F.regexp_substr(text, F.lit(NUMBER))), low, high)


def unfenced(text: Column) -> Column:
    """The inside of a Markdown code fence, or the text."""

    def open_fence(t: Column) -> Column:
        inner = F.regexp_replace(t, r"^```[^\n]*(\n|$)", "")
        inner = F.regexp_replace(inner, r"(^|\n)[ \t]*```[ \t]*$", "")
        return F.when(F.startswith(t, F.lit("```")), stripped(inner)).otherwise(t)

    return bound(stripped(text), open_fence)


def json_span(text: Column) -> Column:
    """The first balanced {...} of a text, quotes and escapes minded; else null."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(acc: Column, ch: Column) -> Column:
        plain = ~acc["escaped"]
        free = plain & ~acc["quoted"]
        depth = acc["depth"] + F.when(free & (ch == "{"), 1).when(free & (ch == "}"), -1).otherwise(0)
        at = acc["at"] + 1
        return F.struct(
            at.alias("at"),
            depth.alias("depth"),
            F.when(plain & (ch == '"'), ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"),
            (plain & (ch == "\\")).alias("escaped"),
            F.when((acc["end"] == 0) & free & (ch == "}") & (depth == 0), at).otherwise(acc["end"]).alias("end"),
        )

    def span(tail: Column) -> Column:
        return bound(F.aggregate(F.split(tail, ""), start, step)["end"], lambda end: F.when(end > 0, F.substr(tail, F.lit(1), end)))

    tail = bound(unfenced(text), lambda body: F.when(F.instr(body, "{") > 0, F.substr(body, F.instr(body, "{"))))
    return bound(tail, span)


def json_object(text: Column) -> Column:
    """The JSON object in a text as a variant; null without one."""
    return bound(F.try_parse_json(json_span(text)), lambda value: F.when(F.schema_of_variant(value).startswith("OBJECT"), value))


def json_number(value: Column, low, high) -> Column:
    """A variant that is a number, not a boolean or string, on the scale."""
    return bound(value, lambda v: F.when(F.schema_of_variant(v).rlike(NUMERIC_KINDS), within(F.try_variant_get(v, "$", "double"), low, high)))


def json_field(payload: Column, key: str) -> Column:
    return F.try_variant_get(payload, f'$["{key}"]', "variant")


def json_text(payload: Column, key: str) -> Column:
    """A field that is a string."""
    return bound(json_field(payload, key), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def last_on_scale(text: Column, pattern: str, low, high) -> Column:
    """Of all matches of ``pattern`` (one group, a number) the last on the scale."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), as_number)
    return F.try_element_at(F.filter(found, lambda x: x.between(low, high)), F.lit(-1))


def final_score(text: Column, low, high) -> Column:
    """A score by JSON field, else by 'final score: n', else 'score: n', else the first number."""
    # fixed values: how answers name their score
    fields = bound(json_object(text), lambda p: F.coalesce(*[json_number(json_field(p, k), low, high) for k in ("score", "final_score")]))
    return F.coalesce(
        fields,
        last_on_scale(text, rf"(?i)final\s*score\s*[:=]\s*({NUMBER})", low, high),
        last_on_scale(text, rf"(?i)score\s*[:=]\s*({NUMBER})", low, high),
        first_number(text, low, high),
    )


def plain_choice(text: Column) -> Column:
    """A or B: the whole text, its start, or a letter of its own anywhere."""

    # fixed values: how answers name their choice
    def pick(t: Column) -> Column:
        lead = F.nullif(F.regexp_extract(t, r"^\s*([AB])(?:\b|[^A-Z])", 1), F.lit(""))
        lone = F.nullif(F.regexp_extract(t, r"\b([AB])\b", 1), F.lit(""))
        return F.coalesce(F.when(t.isin("A", "B"), t), lead, lone)

    return bound(F.upper(stripped(text)), pick)


def choice(text: Column) -> Column:
    """A or B, by a field of a JSON object first."""
    fields = bound(json_object(text), lambda p: F.coalesce(*[plain_choice(json_text(p, k)) for k in CHOICE_KEYS]))
    return F.coalesce(fields, plain_choice(text))


def boolean(value: Column) -> Column:
    """true, yes, y, 1 and their opposites, in a string."""
    return bound(F.lower(stripped(value)), lambda v: F.when(v.isin("true", "yes", "y", "1"), True).when(v.isin("false", "no", "n", "0"), False))


def json_boolean(payload: Column, key: str) -> Column:
    """A boolean or a string that says one; numbers don't."""


    def read(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(kind == "STRING", boolean(F.try_variant_get(value, "$", "string")))

    return bound(json_field(payload, key), read)


def object_of(payload: Column, key: str | None = None) -> Column:
    """A field that is an object (the payload itself without a key) as a map."""
    value = payload if key is None else json_field(payload, key)
    return bound(value, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")))


def strings(condition: Column, *values: str) -> Column:
    """The strings where the condition holds, else none."""
    return F.when(condition, F.array(*[F.lit(v) for v in values])).otherwise(F.array().cast("array<string>"))


def named(values: list[str] | Column) -> Column:
    """An array column as it is, or of literal strings."""
    return values if isinstance(values, Column) else F.array(*[F.lit(x) for x in values])


def label_scores(text: Column, expected: list[str] | Column, low, high) -> Column:
    """All labels' scores of an answer: scores, missing, extra, invalid, error."""
    names = named(expected)
    no_map, no_list = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")

    def checked(known: Column, held: Column, present: Column) -> Column:
        numbers = F.transform_values(known, lambda k, v: json_number(v, low, high))

        def report(scores: Column) -> Column:
            missing = F.filter(names, lambda k: ~F.coalesce(F.map_contains_key(scores, k), F.lit(False)))
            extra = F.array_sort(F.filter(F.map_keys(held), lambda k: ~F.array_contains(names, k)))
            bad = F.map_filter(known, lambda k, v: ~F.map_contains_key(scores, k))
            exact = (F.size(scores) == F.size(names)) & (F.size(known) == F.size(names)) & (F.size(held) == F.size(names))
            error = (
                F.when(~present, F.lit("response did not contain a JSON object"))
                .when(held.isNull(), F.lit("JSON scores field was not an object"))
                .when(~exact, F.lit("JSON scores did not exactly match expected emotions and numeric scale"))
            )
            return F.struct(
                F.coalesce(scores, F.create_map().cast("map<string,double>")).alias("scores"), missing.alias("missing"), F.coalesce(extra, no_list).alias("extra"),
                F.coalesce(F.transform_values(bad, lambda k, v: F.to_json(v)), no_map).alias("invalid"), error.alias("error"),
            )

        return bound(F.map_filter(numbers, lambda k, v: v.isNotNull()), report)

    def source(payload: Column) -> Column:
        named = F.array_contains(F.map_keys(object_of(payload)), "scores")
        return F.struct(payload.isNotNull().alias("present"), F.when(named, object_of(payload, "scores")).otherwise(object_of(payload)).alias("held"))

    def known(s: Column) -> Column:
        inside = F.map_filter(s["held"], lambda k, v: F.array_contains(names, k))
        return bound(inside, lambda m: checked(m, s["held"], s["present"]))

    return bound(bound(json_object(text), source), known)


def contrastive_scores(text: Column, low, high) -> Column:
    """Two numbers, emotion_score and opposite_score, both required."""

    def read(payload: Column) -> Column:
        return F.struct(payload.isNotNull().alias("present"), *[json_number(json_field(payload, k), low, high).alias(k) for k in ("emotion_score", "opposite_score")])

    def report(r: Column) -> Column:
        lacking = r["emotion_score"].isNull() | r["opposite_score"].isNull()
        error = F.when(~r["present"], F.lit("response did not contain a JSON object")).when(lacking, F.lit("JSON did not contain numeric emotion_score and opposite_score within scale"))
        return F.struct(r["emotion_score"].alias("emotion_score"), r["opposite_score"].alias("opposite_score"), error.alias("error"))

    return bound(bound(json_object(text), read), report)


def feature_scores(text: Column, features: list[str] | Column, low, high) -> Column:
    """Scores per feature with observations, an overall score and its reason.

    A missing or bad number is an error; other departures are a warning.
    """
    names = named(features)
    top = F.array(*[F.lit(x) for x in ("observations", "scores", "overall_score", "overall_reason")])
    none = F.create_map().cast("map<string,variant>")
    inside = lambda m: F.map_filter(m, lambda k, v: F.array_contains(names, k))
    beyond = lambda m: F.filter(F.map_keys(m), lambda k: ~F.array_contains(names, k))
    said = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def read(payload: Column) -> Column:
        return F.struct(
            payload.isNotNull().alias("present"), F.map_keys(object_of(payload)).alias("keys"),
            F.coalesce(object_of(payload, "scores"), none).alias("scores"), F.coalesce(object_of(payload, "observations"), none).alias("notes"),
            json_number(json_field(payload, "overall_score"), low, high).alias("overall"), json_text(payload, "overall_reason").alias("reason"),
        )

    def narrow(r: Column) -> Column:
        numbers = F.transform_values(inside(r["scores"]), lambda k, v: json_number(v, low, high))
        notes = F.transform_values(inside(r["notes"]), lambda k, v: said(v))
        return F.struct(
            r.alias("r"), F.map_filter(numbers, lambda k, v: v.isNotNull()).alias("scores"),
            F.map_filter(notes, lambda k, v: F.coalesce(F.length(stripped(v)) > 0, F.lit(False))).alias("notes"),
            F.when(F.length(stripped(r["reason"])) > 0, r["reason"]).alias("reason"),
        )

    def lists(n: Column) -> Column:
        r = n["r"]
        no_score = F.concat(F.filter(names, lambda k: ~F.map_contains_key(n["scores"], k)), strings(r["overall"].isNull(), "overall_score"))
        no_note = F.filter(names, lambda k: ~F.map_contains_key(n["notes"], k))
        extra = F.concat(
            F.array_sort(F.array_except(r["keys"], top)), F.transform(beyond(r["scores"]), lambda k: F.concat(F.lit("scores."), k)),
            F.transform(beyond(r["notes"]), lambda k: F.concat(F.lit("observations."), k)),
        )
        invalid = (F.size(n["scores"]) < F.size(inside(r["scores"]))) | (F.array_contains(r["keys"], "overall_score") & r["overall"].isNull())
        return F.struct(n.alias("n"), no_score.alias("no_score"), no_note.alias("no_note"), extra.alias("extra"), invalid.alias("invalid"))

    def report(x: Column) -> Column:
        n, present = x["n"], x["n"]["r"]["present"]
        missing = F.when(~present, F.concat(names, F.array(F.lit("overall_score")))).otherwise(
            F.concat(x["no_score"], F.transform(x["no_note"], lambda k: F.concat(F.lit("observations."), k)), strings(n["reason"].isNull(), "overall_reason"))
        )
        error = F.when(~present, F.lit("response did not contain a JSON object")).when((F.size(x["no_score"]) > 0) | x["invalid"], F.lit("JSON did not contain every expected numeric score within scale"))
        departs = (F.size(x["no_note"]) > 0) | n["reason"].isNull() | (F.size(x["extra"]) > 0)
        warning = F.when(present & departs, F.lit("JSON evidence fields did not exactly match the requested structure"))
        return F.struct(
            n["scores"].alias("scores"), n["notes"].alias("observations"), n["r"]["overall"].alias("overall_score"), n["reason"].alias("overall_reason"),
            missing.alias("missing"), F.coalesce(x["extra"], F.array().cast("array<string>")).alias("extra"), error.alias("error"), warning.alias("warning"),
        )

    return bound(bound(bound(bound(json_object(text), read), narrow), lists), report)


def probe(text: Column, condition: Column) -> Column:
    """Answers to the repeat probe: JSON fields, else 'key: value' in the text."""
    flags = ("target_present", "target_before_repeat", "target_after_repeat")
    said = ("transcript", "before_repeat_transcript", "after_repeat_transcript")

    def spoken(key: str) -> Column:
        return boolean(F.regexp_extract(F.lower(text), rf"{key}\s*[:=]\s*(true|false|yes|no)", 1))

    def read(payload: Column) -> Column:
        there = payload.isNotNull()
        return F.struct(there.alias("present"), *[F.when(there, json_boolean(payload, k)).otherwise(spoken(k)).alias(k) for k in flags], *[json_text(payload, k).alias(k) for k in said])

    def report(r: Column) -> Column:
        alone = condition == "without_repeat"
        lacking = F.when(alone, r[flags[0]].isNull()).otherwise(r[flags[1]].isNull() | r[flags[2]].isNull())
        what = F.when(alone, F.lit("missing boolean target_present")).otherwise(F.lit("missing boolean target_before_repeat or target_after_repeat"))
        return F.struct(
            F.when(alone, r[flags[0]]).alias(flags[0]), *[F.when(~alone, r[k]).alias(k) for k in flags[1:]],
            F.when(alone, r[said[0]]).alias(said[0]), *[F.when(~alone, r[k]).alias(k) for k in said[1:]],
            F.when(lacking, F.when(~r["present"], F.lit("response did not contain a JSON object")).otherwise(what)).alias("error"),
        )

    return bound(bound(json_object(text), read), report)


def scale_suffix(low: Column, high: Column) -> Column:
    return F.concat_ws("_", low.cast("int"), high.cast("int"))


def asr_text(text: Column) -> Column:
    """Transcripts for target search: lower case, all but a-z, digits and spaces gone to a space, single spaces.

    This is the plain rule; an English normaliser that spells out numbers and
    contractions can be passed to ``operators.speech.normalised`` instead.
    """
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9 ]+", " "), r"\s+", " "))


def word_text(text: Column) -> Column:
    """Lower case, letters a-z and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def target_hit(text: Column, targets: Column) -> Column:
    """Whether any normalised target is part of the normalised text; an empty one always is."""
    whole = word_text(text)
    return F.exists(targets, lambda t: F.contains(whole, word_text(t)))


def split_once(text: Column, separators: Column) -> Column:
    """(before, after) the first separator, in list order, that occurs; else (text, null)."""
    low = F.lower(text)
    sep = F.get(F.filter(separators, lambda s: F.contains(low, F.lower(s))), F.lit(0))
    at = F.instr(low, F.lower(sep))
    return F.struct(
        F.when(sep.isNull(), text).otherwise(F.substr(text, F.lit(1), at - 1)).alias("before"),
        F.when(sep.isNotNull(), F.substr(text, at + F.length(sep))).alias("after"),
    )


def clean_transcript(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" '"), F.lit("'")), r"\s+", " "))


def snippet(text: Column, size: int = 500) -> Column:
    """One line of at most ``size`` characters."""
    line = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(line) > size, F.concat(F.left(line, F.lit(size - 3)), F.lit("..."))).otherwise(line)


def human_bytes(n: Column) -> Column:
    """Bytes in units of 1024, one decimal; plain bytes below."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", n / F.lit(float(1024**i)))).otherwise(out)
    return out


def file_slug(label: Column) -> Column:
    """A label in a file's name: '/' as space, '&' as 'and', white space as '-'."""
    return F.regexp_replace(stripped(F.replace(F.replace(F.lower(label), F.lit("/"), F.lit(" ")), F.lit("&"), F.lit("and"))), r"\s+", "-")


def audio_name(row_id: Column, label: Column, extension: Column) -> Column:
    """The file of a sample: number, label, extension."""
    return F.concat(zero_padded(row_id, 6), F.lit("_"), file_slug(label), extension)


def output_name(index: Column, item_id: Column) -> Column:
    """The file of generated speech: number and the id, made safe and at most 96 characters long, or 'item_' and the number."""
    clean, number = F.left(safe_id(item_id), F.lit(96)), zero_padded(index, 4)
    return F.concat(number, F.lit("_"), F.when(F.length(clean) > 0, clean).otherwise(F.concat(F.lit("item_"), number)), F.lit(".wav"))


def zero_padded(number: Column, width: int) -> Column:
    """With zeros before it up to ``width`` characters; longer ones stay whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def slug(value: Column) -> Column:
    """Lower case, '/' as '-', '&' as 'and', white space as '-'."""
    v = F.replace(F.replace(F.lower(value), F.lit("/"), F.lit("-")), F.lit("&"), F.lit("and"))
    return F.regexp_replace(stripped(v), r"\s+", "-")


def safe_id(value: Column) -> Column:
    """Only letters, digits, '.', '_' and '-'; none of the last three at the ends."""
    return F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")


def filled(template: str, **values: Column) -> Column:
    """A template with {name} fields and doubled braces for single ones."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        parts += [F.lit(literal)] if literal else []
        parts += [values[field]] if field is not None else []
    return F.concat(*parts) if parts else F.lit("")


def votes_of(raw: Column) -> Column:
    """A list of one-key maps {annotator: {label: score}}, single quotes allowed."""
    return F.from_json(raw, "array<map<string,map<string,int>>>", {"allowSingleQuotes": "true"})


def edit_distance(a: list, b: list) -> int:
    """Edit distance of two word lists.

    What both begin and end with costs nothing.  Of the rest, a column of the
    table of distances is kept as two bit vectors, of its steps up and down,
    and a word of ``b`` moves all of them by a few operations on whole
    integers; so time is the product of both lengths by the bits of a machine
    word, and memory a few bits a word.
    """
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    back = 0
    while back < high - low and a[-1 - back] == b[-1 - back]:
        back += 1
    a, b = a[low : len(a) - back], b[low : len(b) - back]
    if not len(a) or not len(b):
        return len(a) + len(b)
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, out = every, 0, len(a)
    for w in b:
        same = places.get(w, 0)
        level = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (every & ~(level | up)), up & level
        out += bool(right_up & last) - bool(right_down & last)
        right_up, right_down = right_up << 1 | 1, right_down << 1
        up, down = (right_down | ~(same | down | right_up)) & every, right_up & (same | down) & every
    return out


def word_distances(x: pa.Array, y: pa.Array) -> pa.Array:
    """Edit distances of the word lists of two Arrow arrays; words are told apart by number, one pair's lists are unpacked at a time."""
    sizes = [pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False) for a in (x, y)]
    codes = pa.concat_arrays([x.flatten(), y.flatten()]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    ends = [np.cumsum(n) + first for n, first in zip(sizes, (0, sizes[0].sum()), strict=True)]
    known = pc.and_(x.is_valid(), y.is_valid()).to_pylist()
    part = lambda k, i: codes[ends[k][i] - sizes[k][i] : ends[k][i]].tolist()
    return pa.array([edit_distance(part(0, i), part(1, i)) if ok else None for i, ok in enumerate(known)], pa.int64())


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays, of any length; null if one is."""

    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        return word_distances(x, y)

    return F.arrow_udf(compare, "long")(a, b)


def words(text: Column) -> Column:
    """The words of a normalised text; none of an empty one."""
    return F.filter(F.split(word_text(text), " "), lambda w: w != "")


def error_rate(edits: Column, reference: Column, hypothesis: Column) -> Column:
    """Edits by reference words; an empty reference gives 0 or, with a hypothesis, NaN."""
    none = F.when(F.size(hypothesis) == 0, F.lit(0.0)).otherwise(F.lit(float("nan")))
    return F.when(F.size(reference) == 0, none).otherwise(edits / F.size(reference))


def to_mos(score: Column, suffix: Column) -> Column:
    """A score of scale 1-10 or 0-10 on the MOS scale 1-5; others as they are."""
    return F.when(suffix == "1_10", 1 + (score - 1) / 9 * 4).when(suffix == "0_10", 1 + score / 10 * 4).otherwise(score)


def rate(n: Column, d: Column) -> Column:
    """n / d; NaN for nothing."""
    return F.when(d == 0, F.lit(float("nan"))).otherwise(n / F.nullif(d, F.lit(0)))
