"""Scalar functions on labels, slugs, model answers and names, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence words, crop names that count as the crop class, and origins by slug prefix.
CONFIDENCE_WORDS = {"high": 0.9, "medium": 0.6, "low": 0.3}
CROP_NAMES = ("crop", "cotton")
SLUG_PREFIXES = {"gh_": "github", "kg_": "kaggle", "rf_": "roboflow"}


def has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def class_key(label: Column) -> Column:
    """Trimmed, lower-cased, without a `class N:` prefix."""
    return F.trim(F.regexp_replace(F.lower(F.trim(label)), r"^class\s*\d+\s*:\s*", ""))


def class_binary(label: Column, crops: Sequence[str] = CROP_NAMES) -> Column:
    """1 for crops, 0 for all else and null."""
    k = class_key(label)
    return F.when(k.isin(*crops) | F.contains(k, F.lit("crop")), 1).otherwise(0)


def class_name(label: Column) -> Column:
    return F.coalesce(class_key(label), F.lit("unknown"))


def confidence(value: Column, ignore_case: bool = True) -> Column:
    """A number as it is; high, medium and low as 0.9, 0.6 and 0.3; 0.5 for anything else."""
    word = F.lower(F.trim(value)) if ignore_case else value
    out = F.expr("cast(null as double)")
    for name, number in CONFIDENCE_WORDS.items():
        out = F.when(word == name, number).otherwise(out)
    return F.coalesce(value.try_cast("double"), out, F.lit(0.5))


def slugify(name: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.left(F.lower(F.replace(F.replace(name, F.lit("/"), F.lit("__")), F.lit("-"), F.lit("_"))), F.lit(60)))


def slug_source(slug: Column, default: str = "huggingface") -> Column:
    out = F.lit(default)
    for prefix, name in SLUG_PREFIXES.items():
        out = F.when(F.startswith(slug, F.lit(prefix)), name).otherwise(out)
    return out


def tags(text: Column, keywords: dict[str, Sequence[str]], default: str = "Unclassified") -> Column:
    """All names with a keyword in the lower-cased text, in the order given; [default] if none."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(has_any(low, words), name) for name, words in keywords.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def first_keyword(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The action of the first rule (keyword, action) whose keyword stands in the lower-cased text."""
    low, out = F.lower(text), F.lit(default)
    for word, action in reversed(rules):
        out = F.when(F.contains(low, F.lit(word)), action).otherwise(out)
    return out


def first_digit(text: Column, actions: Sequence[str]) -> Column:
    """The action (from 1) that the first digit names; null if there is none or it names no action."""
    digit = F.regexp_extract(text, r"(\d)", 1).try_cast("int")
    return F.when(digit.between(1, len(actions)), F.get(F.array(*map(F.lit, actions)), digit - 1))


def parsable(text: Column) -> Column:
    """The text if it is a JSON value and no more. Inside an object, what follows a value can't be overlooked."""
    return F.when(F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull(), text)


def extract_json(text: Column) -> Column:
    """JSON in a model's answer: all of it, the first fence marked json, the first fence, or the outermost braces; the
    first of these that parses, as text."""
    group = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    tries = [F.trim(text), group(r"(?s)```json\s*(.*?)\s*```"), group(r"(?s)```\s*(.*?)\s*```"), group(r"(?s)(\{.*\})")]
    return F.coalesce(*[parsable(t) for t in tries])


def md5_slot(name: Column, slots: int = 88, first: int = 12) -> Column:
    """The MD5 of the name as a whole number, modulo `slots`, plus `first`."""
    digest = F.md5(name)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    shift = 2**64 % slots
    return ((half(1) % slots * shift + half(17) % slots) % slots + first).cast("int")


def experiment_id(dataset: Column, model: Column) -> Column:
    clean = lambda c: F.translate(c, ":/", "__")
    return F.concat_ws("__", clean(dataset), clean(model))


def event_id(kind: Column, seconds: Column) -> Column:
    return F.format_string("%s_%.6f", kind, seconds)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def path_suffix(path: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r".(\.[^.]*)$", 1)


def label_path(path: Column) -> Column:
    """The label file beside an image: the last images folder becomes labels, the suffix .txt."""
    return F.regexp_replace(F.regexp_replace(path, r"(^|.*/)images/", "$1labels/"), r"\.[^./]*$", ".txt")


def hash_bits(bits: Column) -> Column:
    """64 bits, the first the highest, as an unsigned whole number in decimal(20,0)."""
    half = lambda a: F.aggregate(a, F.lit(0).cast("decimal(20,0)"), lambda acc, b: (acc * 2 + b.cast("decimal(20,0)")).cast("decimal(20,0)"))
    return half(bits)


def remote_control(line: Column) -> Column:
    """Map of channels and switches from `DATA ... CH1:1500 SW:0001000` lines."""
    return F.str_to_map(F.regexp_replace(line, r"^DATA\s*", ""), F.lit(" "), F.lit(":"))


def frame_tag(payload: Column) -> Column:
    """The first byte of a binary frame, which names its kind."""
    return F.hex(F.substring(payload, 1, 1))


def truncated(text: Column, most: int) -> Column:
    return F.left(text, F.lit(most))


def cache_key(*parts: Column) -> Column:
    """SHA-1 of the parts, joined by a slash."""
    return F.sha1(F.concat_ws("/", *parts))


def safe_name(name: Column, suffixes: Sequence[str] = ()) -> Column:
    """Whether a name is made of letters, digits, `_`, `.` and `-` alone; with suffixes, whether it is a file name with one
    of them, which may hold spaces."""
    if not suffixes:
        return F.coalesce(name.rlike(r"\A[A-Za-z0-9_.-]+\z"), F.lit(False))
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_. -]+\.(" + "|".join([*suffixes, *[x.upper() for x in suffixes]]) + r")\z"), F.lit(False))


def class_index(label: Column, names: Sequence[str], aliases: dict[str, str]) -> Column:
    """The place of a label among class names: equal, by alias (lower-cased, `_` as space), or the first name that holds
    the label or is held by it; 0 if none is."""
    said = F.trim(label)
    low = F.replace(F.lower(said), F.lit("_"), F.lit(" "))
    out = F.lit(0)
    for k, name in reversed(list(enumerate(names))):
        out = F.when(F.contains(low, F.lit(name.lower())) | F.contains(F.lit(name.lower()), low), k).otherwise(out)
    for alias, name in aliases.items():
        out = F.when(low == alias, names.index(name)).otherwise(out)
    for k, name in reversed(list(enumerate(names))):
        out = F.when(said == name, k).otherwise(out)
    return out


def known_species(name: Column, known: Sequence[str]) -> Column:
    """Whether a species' name holds a known one, or its genus is one."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return has_any(low, known) | F.split(F.trim(low), r"\s+")[0].isin(*known)


def at_path(document: Column, path: str, default: Column | None = None) -> Column:
    """The value at a dotted path of a JSON text, the default if there is none or it is null."""
    value = F.get_json_object(document, "$" + "".join(f"['{k}']" for k in path.split(".")))
    return value if default is None else F.coalesce(value, default)


#: What a proposed strategy must hold, what it may leave out, and what stands in for one that can't be read.
STRATEGY_MUST = ("vlm_models", "min_votes", "lr", "epochs", "replay_ratio")
STRATEGY_MAY = {"consensus_iou": "0.3", "use_yolo_old": "true", "freeze_layers": "0", "name": "brain_proposed"}
STRATEGY_ELSE = {"vlm_models": '["florence2_base","owlv2"]', "min_votes": "2", "consensus_iou": "0.3", "use_yolo_old": "true", "lr": "0.0008", "epochs": "60", "freeze_layers": "0", "replay_ratio": "0.4", "name": "brain_fallback"}


def strategy(answer: Column) -> Column:
    """The strategy in a model's answer, as a struct of texts: the first object without inner objects that names
    vlm_models, if it parses and holds all of STRATEGY_MUST; defaults for what it may leave out; else the fixed one."""
    found = F.regexp_extract(answer, r'(?s)(\{[^{}]*"vlm_models"[^{}]*\})', 1)
    fine = F.try_parse_json(found).isNotNull() & reduce(lambda a, b: a & b, [F.get_json_object(found, f"$.{k}").isNotNull() for k in STRATEGY_MUST])
    fields = []
    for name, instead in STRATEGY_ELSE.items():
        own = F.get_json_object(found, f"$.{name}")
        own = F.coalesce(own, F.lit(STRATEGY_MAY[name])) if name in STRATEGY_MAY else own
        fields.append(F.when(F.coalesce(fine, F.lit(False)), own).otherwise(instead).alias(name))
    return F.struct(*fields)
