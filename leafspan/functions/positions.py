"""Positions and values of a document, weights of paths, and kernels and certificates built on them. All are expressions over documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels
from .leaves import shown

#: One step of a printed path: a plain key, a quoted key, an index.
STEP = r'(\.[A-Za-z_][A-Za-z0-9_-]*|\["(?:[^"\\]|\\.)*"\]|\[[0-9]+\])'
INDEX = r"^\[[0-9]+\]$"
#: Lengths of strings that are worth an embedding.
LEAST_LENGTH, CHUNK_LENGTH = 4, 300


def steps(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(STEP), F.lit(1))


def key_of(step: Column) -> Column:
    """The key that a step names; null for an index."""
    quoted = F.try_variant_get(F.try_parse_json(F.regexp_extract(step, r'^\[(".*")\]$', 1)), "$", "string")
    return F.when(step.startswith("."), F.substring(step, 2, 1 << 20)).when(step.startswith('["'), quoted)


def prefixes(path: Column) -> Column:
    """Every node on the way to a path, the root first and the path last."""
    return kernels.bound(steps(path), lambda s: F.transform(F.sequence(F.lit(0), F.size(s)), lambda n: F.concat(F.lit("$"), F.array_join(F.slice(s, F.lit(1), n), ""))))


def nodes(doc: Column) -> Column:
    """The paths of all nodes of a document, inner ones too."""
    return F.array_distinct(F.flatten(F.transform(F.map_keys(doc), prefixes)))


def identity(leaf: Column) -> Column:
    """A value with its type, so that "1", 1 and true differ. JSON has one kind of number here: 1 and 1.0 are equal."""
    return F.concat(leaf["vtype"], F.lit(":"), shown(leaf))


def positions(doc: Column, exchangeable: bool = False) -> Column:
    """Array of (position, value): paths without their root; empty containers end in {} or []. exchangeable: elements of an array share a position [*],
    which then occurs once for each of them (a consumer pools them)."""
    marks = F.create_map(F.lit("empty_object"), F.lit("{}"), F.lit("empty_array"), F.lit("[]"))

    def one(e: Column) -> Column:
        at = F.regexp_replace(e["key"], r"^\$\.?", "")
        at = F.regexp_replace(at, r"\[[0-9]+\]", "[*]") if exchangeable else at
        return F.struct(F.concat(at, F.coalesce(F.try_element_at(marks, e["value"]["vtype"]), F.lit(""))).alias("position"), identity(e["value"]).alias("value"))

    return F.transform(F.map_entries(doc), one)


def entailed(position: Column, others: Column) -> Column:
    """Whether an empty container's position says only what the other side's positions below it say."""
    base = F.regexp_replace(position, r"(\{\}|\[\])$", "")
    below = F.exists(others, lambda q: ((base == "") & ~q.isin("{}", "[]")) | (base != "") & (q.startswith(F.concat(base, F.lit("."))) | (q.startswith(F.concat(base, F.lit("["))) & (q != F.concat(base, F.lit("[]"))))))
    return position.rlike(r"(\{\}|\[\])$") & below


def string_values(doc: Column) -> Column:
    """All strings of a document, in order of its paths."""
    return F.transform(F.filter(F.map_values(doc), lambda x: x["vtype"] == "string"), lambda x: x["sval"])


def strings_to_embed(doc: Column, words) -> Column:
    """Different keys, keys as words (by `words`) and strings of a document that are long enough; strings of a chunk's length and more are left out."""
    keys = F.filter(F.array_distinct(F.transform(F.flatten(F.transform(F.map_keys(doc), steps)), key_of)), lambda k: k.isNotNull())
    long = lambda xs: F.filter(xs, lambda x: F.length(x) >= LEAST_LENGTH)
    strings = F.filter(string_values(doc), lambda x: F.length(x) < CHUNK_LENGTH)
    worded = F.transform(long(keys), words)
    return F.array_sort(F.array_distinct(F.concat(long(keys), long(worded), long(strings))))


def element_count(doc: Column) -> Column:
    """Keys, elements and scalars of a document: every node but the root, and each scalar once more."""
    scalars = F.size(F.filter(F.map_values(doc), lambda x: ~x["vtype"].startswith("empty_")))
    return F.size(nodes(doc)) - 1 + scalars


def path_weight(path: Column, decay: float = 1.0, required: tuple[str, ...] = ()) -> Column:
    """decay for each step, half more for a required path."""
    w = F.pow(F.lit(float(decay)), F.size(steps(path)))
    return F.when(path.isin(*required), w * 1.5).otherwise(w) if required else w


def edit_cost(path: Column, decay: float = 1.0, required: tuple[str, ...] = ()) -> Column:
    """What inserting or deleting a node costs: its weight, 1 at most."""
    return F.least(F.lit(1.0), path_weight(path, decay, required))


def edit_radius(score: Column, tau: float | None, longest: Column) -> Column:
    """The greatest edit distance that a leaf score allows between strings of a greatest length; null where it certifies nothing."""
    if tau is None or tau <= 0:
        return F.lit(None).cast("double")
    share = (score - (1.0 - tau)) / tau
    return F.when(score > 1.0 - tau, F.greatest(F.lit(0.0), (1 - share) * longest))


def document_radius(score: Column, tau: float | None, weight: float, longest: Column) -> Column:
    """The same from a document's least score under the product of channels."""
    return F.lit(None).cast("double") if weight >= 1 else edit_radius(F.pow(score, F.lit(1 / (1 - weight))), tau, longest)


def blended(literal: Column, semantic: Column, tau: float) -> Column:
    """tau of the literal kernel, the rest of the semantic one; the ends are exact."""
    return literal if tau == 1 else semantic if tau == 0 else tau * literal + (1 - tau) * semantic


def semantic_kernel(a: Column, b: Column, va: Column, vb: Column) -> Column:
    """Strings by the cosine of their vectors; by characters where either is short or has no vector."""
    short = (F.length(a) < LEAST_LENGTH) | (F.length(b) < LEAST_LENGTH) | va.isNull() | vb.isNull()
    return F.when(short, kernels.char_similarity(a, b)).otherwise(kernels.cosine(va, vb))


def chunk_kernel(a: Column, b: Column, kernel=kernels.char_similarity) -> Column:
    """Two arrays of chunks of long texts: the mean of both sides' mean best matches. Each chunk is held against each."""
    best = lambda xs, ys: F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.array_max(F.transform(ys, lambda y: kernel(x, y)))) / F.size(xs)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise((best(a, b) + best(b, a)) / 2)


def chunks(text: Column, size: int = CHUNK_LENGTH) -> Column:
    """A text cut into pieces of so many characters; an empty text has none."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def is_callee(path: Column, doc: Column) -> Column:
    """A path that names what is called: `name` in an object that also has `arguments`."""
    beside = F.concat(F.regexp_replace(path, r"\.name$", ""), F.lit(".arguments"))
    return path.endswith(".name") & F.exists(F.map_keys(doc), lambda k: (k == beside) | k.startswith(F.concat(beside, F.lit("."))) | k.startswith(F.concat(beside, F.lit("["))))


def exact_where(scores: Column, doc: Column, fields: tuple[str, ...] = (), callees: bool = True) -> Column:
    """Field scores with identity in place of likeness: at callees' names, and wherever a path's last key is one of `fields`."""

    def one(path: Column, s: Column) -> Column:
        last = key_of(F.try_element_at(steps(path), F.lit(-1)))
        exact = last.isin(*fields) if fields else F.lit(False)
        exact = exact | is_callee(path, doc) if callees else exact
        return F.when(exact & (s["status"] == "changed"), s.withField("score", F.lit(0.0))).otherwise(s)

    return F.transform_values(scores, one)


def pick(raw: Column, key: str | None = None) -> Column:
    """From JSON text: the value of a key (null where there is none); without a key, the only value of an object of one key, else the text itself."""
    v = F.try_parse_json(raw)
    if key is not None:
        return F.try_variant_get(v, f"$['{key}']", "variant").cast("string")
    only = F.map_values(F.try_variant_get(v, "$", "map<string, variant>"))
    return F.when(F.size(only) == 1, F.get(only, 0).cast("string")).otherwise(raw)
