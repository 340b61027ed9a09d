"""Text parsing of judging data: verdicts, JSON, requirement lists, templates, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import bind

#: Least and greatest verdict of the numeric judge types.
RANGES = {"reward": (0, 100), "preference_score": (0, 10), "preference_5score": (-1, 4), "preference_5score_ver2": (-3, 2)}
#: The verdict of a confused judge, which stays in the other order.
SENTINELS = {"preference_5score": -1, "preference_5score_ver2": -3}
LETTERS = {"preference_binary": ["A", "B"], "preference_ternary": ["A", "B", "Tie"]}


def whole_number(text: Column) -> Column:
    """An int where the text is one, with spaces around it; null for '3.0' and the like."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("int"))


def is_valid(verdict: Column, judge: str, least: int | None = None) -> Column:
    """May this text be a verdict of that judge type?  Unknown types take all."""
    if judge in LETTERS:
        return F.coalesce(verdict.isin(*LETTERS[judge]), F.lit(False))
    if judge in RANGES:
        low, high = RANGES[judge]
        return F.coalesce(whole_number(verdict).between(low if least is None else least, high), F.lit(False))
    return F.lit(True)


def reverse_verdict(verdict: Column, judge: str, mode: str = "fixed") -> Column:
    """The verdict of the same pair in the other order, as text.

    0 .. 4 turn to 4 - x, -2 .. 2 of preference_5score_ver2 to -x.  fixed: sentinels stay, scores of 0 .. 10 turn to 10 - x;
    reference: a sentinel turns as any number (text -1 to 5, text -3 to 3) and other scales stay."""
    if judge in SENTINELS:
        x = whole_number(verdict)
        turned = (4 - x if judge == "preference_5score" else -x).cast("string")
        return F.when(x == SENTINELS[judge], x.cast("string")).otherwise(turned) if mode == "fixed" else turned
    if judge in LETTERS:
        return F.when(verdict == "A", "B").when(verdict == "B", "A").otherwise("Tie")
    if judge == "preference_score" and mode == "fixed":
        return (10 - whole_number(verdict)).cast("string")
    return verdict


def json_verdict(text: Column) -> Column:
    """The verdict field of a JSON answer; null for broken JSON."""
    return F.get_json_object(text, "$.verdict")


def repair_json(text: Column) -> Column:
    """An unfinished explanation, closed so that a verdict can follow."""
    end = '", "verdict":'
    for_ = [r'"\s*,\s*"\s*$', r'"\s*,\s*$', r'"\s*$']
    out = F.concat(text, F.lit(end))
    for p in reversed(for_):
        out = F.when(text.rlike(p), F.regexp_replace(text, p, end)).otherwise(out)
    return out


def after_thinking(text: Column) -> Column:
    return F.trim(F.element_at(F.split(text, "</think>"), -1))


def edge_number(text: Column) -> Column:
    """The number that a text is, or that it begins or else ends with, as text."""
    begin = F.regexp_extract(text, r"^\s*(-?\d+)(?:\D|$)", 1)
    end = F.regexp_extract(text, r"(?:^|\D)(-?\d+)\s*$", 1)
    return F.coalesce(F.when(whole_number(text).isNotNull(), F.trim(text)), F.nullif(begin, F.lit("")), F.nullif(end, F.lit("")))


def letter_verdict(text: Column) -> Column:
    """A or B, whatever the case and the spaces; null for all else."""
    up = F.upper(F.trim(text))
    return F.when(up.isin("A", "B"), up)


def percent_verdict(text: Column) -> Column:
    n = whole_number(text)
    return F.when(n.between(0, 100), n)


def requirements(text: Column) -> Column:
    """Items of 'k) text (importance: n/100)' lists: array of (check_idx, check, importance).

    A piece is an item only if its number is its place; other pieces belong to the item before.
    Text that doesn't begin with 1) has no items; an item without importance has null for it."""
    pieces = F.split(text, r"(?<=/100\)\n)(?=[0-9]+\))")
    zero = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        opens = p.startswith(F.concat((F.size(acc) + 1).cast("string"), F.lit(")")))
        last = F.concat(F.element_at(acc, -1), p)
        return F.when(opens, F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(last))).otherwise(acc)

    items = F.aggregate(pieces, zero, step)
    body = lambda p: F.regexp_replace(p, r"^[0-9]+\)", "")
    each = lambda p, i: F.struct(i.alias("check_idx"), F.trim(F.split_part(body(p), F.lit("(importance:"), F.lit(1))).alias("check"), F.regexp_extract(p, r"\(importance:\s*([0-9]+)/", 1).try_cast("int").alias("importance"))
    return F.when(text.startswith("1)"), F.transform(items, each)).otherwise(F.array().cast("array<struct<check_idx:int,check:string,importance:int>>"))


def fill_template(template: str, **fields: Column) -> Column:
    """A template with {name} fields, filled in one pass: values are never looked into; {{ and }} are braces."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(fields[m[1]].cast("string") if m[1] else F.lit(m[0][0]))
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def messages(user: Column | None = None, assistant: Column | None = None) -> Column:
    """Chat messages of the given texts, each null one left out; an error if both are null."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    both = F.array(*[message(r, t) for r, t in (("user", user), ("assistant", assistant)) if t is not None])
    kept = F.filter(both, lambda m: m["content"].isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.raise_error("a message needs a text").cast("array<struct<role:string,content:string>>"))


def fallback_length(text: Column) -> Column:
    """Tokens of a text where no tokenizer is at hand: a quarter of its characters."""
    return F.floor(F.length(text) / 4)


def short_name(model: Column) -> Column:
    return F.element_at(F.split(model, "/"), -1)


def reward_text(query: Column, response: Column, eos: str, replacement: str = "", most: int | None = None) -> Column:
    """Query and response for a reward model, end marks of the response replaced; only the last `most` words if given."""
    text = F.concat(query, F.lit(" "), F.replace(response, F.lit(eos), F.lit(replacement)))
    return text if most is None else F.array_join(keep_right(F.filter(F.split(text, " "), lambda w: w != ""), most), " ")


def keep_right(tokens: Column, n: int) -> Column:
    """The last n tokens."""
    return F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - n + 1), F.lit(n))


def ngrams(words: Column, n: int) -> Column:
    k = F.size(words) - n + 1
    return F.when(k >= 1, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge_n(candidate: Column, reference: Column, n: int) -> Column:
    """F1 of n-gram multisets of two word arrays; 0 where either has none."""
    a, b = ngrams(candidate, n), ngrams(reference, n)
    side = lambda x, t: F.transform(x, lambda g: F.struct(g.alias("g"), F.lit(t).alias("t")))
    state = lambda g, x, y, s: F.struct(g.alias("g"), x.alias("x"), y.alias("y"), s.alias("s"))
    done = lambda s: s["s"] + F.least(s["x"], s["y"])

    def step(s: Column, e: Column) -> Column:
        same = s["g"].eqNullSafe(e["g"])
        return F.when(same, state(s["g"], s["x"] + 1 - e["t"], s["y"] + e["t"], s["s"])).otherwise(state(e["g"], 1 - e["t"], e["t"], done(s)))

    zero = F.lit(0)
    both = F.aggregate(F.array_sort(F.concat(side(a, 0), side(b, 1))), state(F.lit(None).cast("string"), zero, zero, zero), step, done)  # one merge of the sorted n-grams
    return F.coalesce(F.try_divide(2.0 * both, (F.size(a) + F.size(b)).cast("double")), F.lit(0.0))


def rouge_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, as the usual scorer cuts texts."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


#: Places of a word array that one long of the matching masks holds: a sum of two masks and a carry stays below 2**63.
_BITS = 62


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _masks(words: Column) -> Column:
    """Map of each word to its places: bit i % 62 of long i / 62."""
    blocks = F.ceil(F.size(words) / _BITS).cast("int")
    none = F.array_repeat(F.lit(0).cast("long"), blocks)
    sorted_ = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    entry = "struct<w:string,m:array<bigint>>"
    state = lambda last, m, done: F.struct(last.alias("w"), m.alias("m"), done.alias("done"))

    def step(s: Column, e: Column) -> Column:
        same = s["w"].eqNullSafe(e["w"])
        bit = lambda m: F.transform(m, lambda x, k: F.when(k == F.floor(e["i"] / _BITS).cast("int"), x.bitwiseOR(_bit(e["i"] % _BITS))).otherwise(x))
        closed = F.when(s["w"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["w"].alias("w"), s["m"].alias("m")))))
        return F.when(same, state(s["w"], bit(s["m"]), s["done"])).otherwise(state(e["w"], bit(none), closed))

    last = lambda s: F.concat(s["done"], F.array(F.struct(s["w"].alias("w"), s["m"].alias("m"))))
    start = state(F.lit(None).cast("string"), none, F.array().cast(f"array<{entry}>"))
    return F.map_from_entries(F.aggregate(sorted_, start, step, last))


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two word arrays without nulls; 0 where either is empty, null where null.

    Bit-parallel: b's places lie in longs of 62 bits, and each word of a is a sum with carry and two masks for each long."""
    full = (1 << _BITS) - 1

    def of(both: Column) -> Column:
        n, where = both["n"], both["where"]
        blocks = F.ceil(n / _BITS).cast("int")
        left = lambda k: F.least(F.lit(_BITS), n - k * _BITS)
        ones = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: _bit(left(k)) - 1)

        def word(row: Column, w: Column) -> Column:
            def block(s: Column, k: Column) -> Column:
                v, m = F.get(row, k), F.get(s["m"], k)
                total = v + v.bitwiseAND(m) + s["carry"]
                new = total.bitwiseAND(F.lit(full)).bitwiseOR(v.bitwiseAND(F.lit(full).bitwiseXOR(m)))
                return F.struct(F.concat(s["out"], F.array(new)).alias("out"), F.shiftright(total, _BITS).alias("carry"), s["m"].alias("m"))

            start = lambda m: F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"), m.alias("m"))
            after = lambda m: F.aggregate(F.sequence(F.lit(0), blocks - 1), start(m), block, lambda s: s["out"])
            return bind(F.element_at(where, w), lambda m: F.when(m.isNull(), row).otherwise(after(m)))

        final = F.aggregate(both["a"], ones, word)
        kept = F.aggregate(F.zip_with(final, ones, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
        return n - kept

    empty = (F.size(a) == 0) | (F.size(b) == 0)
    packed = F.struct(F.size(b).alias("n"), a.alias("a"), _masks(b).alias("where"))
    return F.when(a.isNull() | b.isNull(), None).when(empty, 0).otherwise(bind(packed, of))


def rouge_l(candidate: Column | str, reference: Column | str) -> Column:
    """F1 of the longest common subsequence of two word arrays; 0 where either is empty or null."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (candidate, reference))
    score = F.try_divide(2.0 * longest_common(a, b), (F.size(a) + F.size(b)).cast("double"))
    return F.coalesce(score, F.lit(0.0))


def rouge(candidate: Column, reference: Column) -> list[Column]:
    """rouge1, rouge2 and rouge_l of two token arrays."""
    return [rouge_n(candidate, reference, 1).alias("rouge1"), rouge_n(candidate, reference, 2).alias("rouge2"), rouge_l(candidate, reference).alias("rouge_l")]
