"""Text scalars as column expressions: tokens, overlaps, answer matching, identifier styles, the hash encoder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOP_WORDS = (
    "a an the is are was were be been being do does did doing have has had having of in on at to for with by from into "
    "and or but not no if then than this that these those what which who whom whose where when why how can could should "
    "would will i you he she it we they them his her us our your their my me"
).split()
#: Fragments of relations that lead to types, names and aliases.
METADATA_FRAGMENTS = (
    "type.object.type", "common.topic.notable_types", "kg.object_profile", "type.type.instance", "type.namespace.keys", "common.topic.alias",
    "common.topic.image", "freebase.object_profile", "type.object.name", "type.object.key", "common.notable_for", "common.topic.notable_for",
)
#: Fixed values: (question words, relation words) that belong together.
RELATION_HINTS = (
    ("where from born birthplace live located located_in", "place location birth born city country state region nationality containedby place_lived"),
    ("plays played actor actress starring cast", "actor cast starring performance person character role"),
    ("when year date born died start started ended", "date year time birth death start end founding"),
    ("language languages speak spoken", "language spoken official_language"),
    ("religion religious worship believe religions", "religion denomination faith"),
    ("currency money dollar", "currency monetary"),
    ("capital", "capital administrative seat"),
    ("country nation countries nations land", "country nationality containedby located contains borders in_country located_in"),
    ("college university school educational institution alma", "education school university college graduated alma institution campuses"),
    ("who man woman leader ruler president minister politician head official", "leader person president minister head_of_state head spouse official child parent founder"),
    ("team teams sports franchise club league", "team sports franchise club league roster championship fielded"),
    ("movie film films movies", "film movie directed cinematography production"),
    ("stadium venue arena field ground", "stadium venue arena home_arena home_stadium ground"),
)
#: Words that stand for yes and no.
YES = "yes y true t 1 allow allowed permit permitted grant granted".split()
NO = "no n false f 0 deny denied refuse refused reject rejected".split()
#: Python's string.punctuation as a character class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def strings(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def content_tokens(text: Column) -> Column:
    """Distinct lower-case tokens of two characters or more that are no stop words (empty for null)."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)))


def relation_tokens(relation: Column) -> Column:
    return content_tokens(F.translate(relation, "._~", "   "))


def overlap(question: Column, relation: Column) -> Column:
    """Share of the question's tokens that the relation has; 0 if either is empty."""
    return F.when((F.size(question) > 0) & (F.size(relation) > 0), F.size(F.array_intersect(question, relation)) / F.size(question)).otherwise(F.lit(0.0))


def opaque(name: Column) -> Column:
    """An identifier that says nothing, such as ``m.04dryy0``."""
    return F.coalesce(F.trim(name).rlike("^[mg]\\.[0-9a-z_]+$"), F.lit(False))


def opaque_code(name: Column) -> Column:
    """An identifier such as ``Q42``."""
    return F.coalesce(name.rlike("^(Q|P)[0-9]+$"), F.lit(False))


def metadata_relation(relation: Column) -> Column:
    clean = F.lower(F.regexp_replace(F.coalesce(relation, F.lit("")), "^~+", ""))
    return reduce(lambda a, b: a | b, [clean.contains(x) for x in METADATA_FRAGMENTS])


def relation_boost(question: Column, relation: Column) -> Column:
    """4 for each hint that both token sets hit; half of that if the question hits one and the relation none."""
    hits = [(F.arrays_overlap(question, strings(q.split())), F.arrays_overlap(relation, strings(r.split()))) for q, r in RELATION_HINTS]
    boost = reduce(lambda a, b: a * b, [F.when(q & r, F.lit(4.0)).otherwise(F.lit(1.0)) for q, r in hits])
    any_q, any_r = reduce(lambda a, b: a | b, [q for q, _ in hits]), reduce(lambda a, b: a | b, [r for _, r in hits])
    return boost * F.when(any_q & ~any_r, F.lit(0.5)).otherwise(F.lit(1.0))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def normalized(text: Column) -> Column:
    """Lower case, punctuation as blanks, single blanks."""
    return squeezed(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " "))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: inside of a lambda Spark shares no common parts."""
    return F.transform(F.array(value), then)[0]


def normalized_answer(text: Column) -> Column:
    """``normalized``, where a text whose first word means yes or no becomes 1 or 0."""

    def answer(n: Column) -> Column:
        head = F.substring_index(n, " ", 1)
        return F.when(head.isin(YES), F.lit("1")).when(head.isin(NO), F.lit("0")).otherwise(n)

    return once(normalized(text), answer)


def exact_match(prediction: Column, golds: Column) -> Column:
    return once(normalized_answer(prediction), lambda p: F.exists(golds, lambda g: normalized_answer(g) == p)).cast("int")


def token_f1(prediction: Column, golds: Column) -> Column:
    """The best F1 of tokens over the golds; tokens in common count as often as they occur on either side."""

    def words(text: Column) -> Column:
        return F.filter(F.split(normalized_answer(text), " "), lambda t: t != "")

    def f1(p: Column, g: Column) -> Column:
        def by(common: Column) -> Column:
            in_p, in_g = F.size(F.filter(p, lambda t: F.array_contains(common, t))), F.size(F.filter(g, lambda t: F.array_contains(common, t)))
            # precision in_p / |p| and recall in_g / |g|
            return F.when(F.size(common) == 0, F.lit(0.0)).otherwise(2.0 * in_p * in_g / (in_p * F.size(g) + in_g * F.size(p)))

        return once(F.array_intersect(p, g), by)

    tokens = F.transform(golds, words)
    return F.coalesce(once(words(prediction), lambda p: F.array_max(F.transform(tokens, lambda g: f1(p, g)))), F.lit(0.0))


def stripped(text: Column) -> Column:
    """Without parentheses and without descriptors such as `` - Season 2``."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "\\s*\\([^)]*\\)\\s*", " ")
    # fixed value: the descriptors that an answer may end in
    return squeezed(F.regexp_replace(bare, "(?i)\\s*-\\s*(Season|Episode|Series|Vol\\.?|Volume|Part)\\s+\\S+\\s*", " "))


MATCH_MODES = ("strict", "paren", "substring", "both")


def relaxed_match(prediction: Column, golds: Column, mode: str) -> Column:
    """Equality after normalisation; ``paren`` strips first, ``substring`` lets either contain the other (3 characters or more)."""
    if mode not in MATCH_MODES:
        raise ValueError(f"mode must be one of {MATCH_MODES}")

    def norm(x: Column) -> Column:
        return normalized(stripped(x)) if mode in ("paren", "both") else normalized(x)

    def hit(p: Column, g: Column) -> Column:
        same = p == g
        if mode in ("substring", "both"):
            same = same | ((F.length(g) >= 3) & p.contains(g)) | ((F.length(p) >= 3) & g.contains(p))
        return (p != "") & (g != "") & same

    return once(norm(prediction), lambda p: F.exists(F.transform(golds, norm), lambda g: hit(p, g))).cast("int")


def uri_name(uri: Column, separators: str = "/#") -> Column:
    """The last segment of a URI with blanks for underscores."""
    return F.trim(F.translate(F.regexp_extract(F.trim(F.coalesce(uri, F.lit(""))), f"[^{separators}]+$", 0), "_", " "))


def identifier_style(name: Column) -> Column:
    return F.when(name.startswith("m.") | name.startswith("g."), F.lit("mid")).when(name.contains(" "), F.lit("surface_with_space")).otherwise(F.lit("other"))


def linearised(s: Column, r: Column, o: Column, style: str = "plain") -> Column:
    return {"plain": F.concat_ws(" ", s, r, o), "tuple": F.concat(F.lit("("), s, F.lit(", "), r, F.lit(", "), o, F.lit(")")), "bars": F.concat(F.lit("("), s, F.lit(" | "), r, F.lit(" | "), o, F.lit(")"))}[style]


def hash_vector(text: Column, dim: int = 64) -> Column:
    """Sum of the MD5 bytes of the lower-cased white-space tokens in dimensions 0 to 15, to unit length; zeros stay zeros."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "(?U)\\s+"), lambda t: t != "")
    width = min(16, dim)

    def byte_sums(words: Column) -> Column:
        def byte_sum(k: Column) -> Column:
            shift = 24 - 8 * (k % 4)
            return F.aggregate(words, F.lit(0).cast("long"), lambda s, h: s + F.call_function("shiftright", F.get(h, (k / 4).cast("int")), shift).bitwiseAND(F.lit(255)))

        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), byte_sum)

    def words(token: Column) -> Column:
        """The digest as four numbers of four bytes."""
        return once(F.md5(token), lambda h: F.array(*[F.conv(h.substr(F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4)]))

    def to_unit(v: Column) -> Column:
        return once(norm(v), lambda n: F.concat(F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))), F.array_repeat(F.lit(0.0), dim - width)))

    return once(once(F.transform(tokens, words), byte_sums), to_unit)


def hash_vectors(text: Column, dim: int = 64) -> Column:
    """``hash_vector`` of many short texts, to the last bit: batches go through Arrow, as Spark doesn't compile lambdas. It
    can't stand inside of a lambda itself."""
    width = min(16, dim)

    @F.arrow_udf("array<double>")
    def vectors(texts: pa.Array) -> pa.Array:
        from hashlib import md5

        words = [[w for w in text.split(" ") if w] for text in texts.to_pylist()]
        flat = [w for some in words for w in some]
        digests = {w: md5(w.encode("utf-8", "surrogatepass")).digest() for w in set(flat)}
        size = np.fromiter(map(len, words), np.int64, len(words))
        so_far = np.zeros((len(flat) + 1, 16), np.int64)
        np.cumsum(np.frombuffer(b"".join([digests[w] for w in flat]), np.uint8).reshape(-1, 16), axis=0, dtype=np.int64, out=so_far[1:])
        end = np.cumsum(size)
        v = (so_far[end] - so_far[end - size])[:, :width].astype(float)
        n = np.sqrt((v * v).sum(1, keepdims=True))
        out = np.zeros((len(size), dim))
        np.divide(v, n, out=out[:, :width], where=n > 0)
        return pa.ListArray.from_arrays(np.arange(0, (len(size) + 1) * dim, dim, dtype=np.int32), pa.array(out.ravel()))

    return vectors(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?U)\\s+", " "))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def snapped(raw: Column, candidates: Column, fallback: Column) -> Column:
    """The candidate that a generated text names: by number, else by equality, else by containment, else ``fallback``."""
    line = F.trim(F.regexp_replace(F.trim(F.substring_index(F.trim(raw), "\n", 1)), "^[-*. ]+|[-*. ]+$", ""))
    number = F.expr("null").cast("int")
    digits = F.regexp_extract(line, "[0-9]+", 0)
    number = F.when(digits != "", digits.try_cast("int"))
    low = F.lower(line)
    by_number = F.when((number >= 1) & (number <= F.size(candidates)), F.get(candidates, number - 1))
    equal = F.get(F.filter(candidates, lambda c: F.lower(c) == low), F.lit(0))
    inside = F.get(F.filter(candidates, lambda c: low.contains(F.lower(c)) & (F.length(c) > 2)), F.lit(0))
    return F.coalesce(by_number, equal, inside, fallback)


def parsed_scores(raw: Column, n: Column) -> Column:
    """One number from the start of each line, as many as there are edges; if there are fewer, 1/n for each."""
    firsts = F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda line: F.substring_index(F.trim(line), " ", 1).try_cast("double"))
    numbers = F.filter(firsts, lambda x: x.isNotNull())
    return F.when(F.size(numbers) >= n, F.slice(numbers, 1, n)).otherwise(F.transform(F.sequence(F.lit(1), n), lambda _: 1 / n))


def lettered_choice(raw: Column, candidates: Column) -> Column:
    """The candidate of the first letter before a closing parenthesis: ``B)`` is the second one."""
    letter = F.regexp_extract(F.coalesce(raw, F.lit("")), "([A-Z])\\)", 1)
    return F.when(letter != "", F.get(candidates, F.ascii(letter) - 65))
