"""Compound-name normalization as pure Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

# Salt and counter-ion words left out of parent names.
SALT_TOKENS = [
    "hydrochloride", "hydrobromide", "hydroiodide", "hemifumarate", "fumarate", "maleate", "tartrate", "succinate",
    "mesylate", "mesilate", "besylate", "besilate", "tosylate", "phosphate", "sulfate", "sulphate", "acetate",
    "citrate", "nitrate", "oxalate", "carbonate", "bromide", "chloride", "iodide", "sodium", "potassium", "calcium",
    "magnesium", "hydrate", "monohydrate", "dihydrate", "trihydrate", "hemihydrate", "sesquihydrate", "anhydrous",
    "hcl", "hbr",
]
# Words that are not part of a name.
DROP_TOKENS = ["blinded"]
# Misspelling -> name, applied always.
TYPO_ALIASES = {"diltizem": "diltiazem"}
# Name -> other identity, applied only on request, with the reason.
IDENTITY_ALIASES = {"dlsotalol": "sotalol"}
IDENTITY_REASONS = {"dlsotalol": 'ChEMBL synonym "DL-SOTALOL"; stereoisomer mixture alias'}


@dataclass(frozen=True)
class NameRules:
    """Word lists and alias maps used to form parent names."""

    left_out: Sequence[str] = field(default_factory=lambda: [*SALT_TOKENS, *DROP_TOKENS])
    typos: Mapping[str, str] = field(default_factory=lambda: dict(TYPO_ALIASES))
    identities: Mapping[str, str] = field(default_factory=lambda: dict(IDENTITY_ALIASES))
    reasons: Mapping[str, str] = field(default_factory=lambda: dict(IDENTITY_REASONS))


DEFAULT_RULES = NameRules()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(name: Column) -> Column:
    """Leading and trailing white space of any kind removed."""
    return F.regexp_replace(name.cast("string"), r"^\s+|\s+$", "")


def folded(name: Column) -> Column:
    """Lower case, with the letters whose case folding is longer than their lower case spelled out."""
    out = F.lower(name)
    for letter, spelled in (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
                            ("ﬅ", "st"), ("ﬆ", "st")):
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return out


def lookup(key: Column, mapping: Mapping[str, str]) -> Column:
    """Mapped value, or the key itself when it is not in the map."""
    if not mapping:
        return key
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return bound(key, lambda k: F.coalesce(F.try_element_at(F.create_map(*pairs), k), k))


def squeezed(name: Column) -> Column:
    """Letters a-z and digits only."""
    return F.regexp_replace(folded(name), "[^a-z0-9]+", "")


def normalized_name(name: Column, rules: NameRules = DEFAULT_RULES) -> Column:
    return lookup(squeezed(stripped(name)), rules.typos)


def parent_name(name: Column, rules: NameRules = DEFAULT_RULES) -> Column:
    """Normalized name without the left-out words; when nothing remains all words are kept."""
    plain = lambda text: F.regexp_replace(text, "[^a-z0-9]+", "")

    def without(low: Column) -> Column:
        if not rules.left_out:
            return plain(low)
        words = "|".join(sorted(rules.left_out, key=len, reverse=True))
        kept = plain(F.regexp_replace(low, f"(?<![a-z0-9])(?:{words})(?![a-z0-9])", ""))
        return bound(kept, lambda k: F.when(k == "", plain(low)).otherwise(k))

    return lookup(bound(folded(stripped(name)), without), rules.typos)


def identity_alias(key: Column, rules: NameRules = DEFAULT_RULES) -> Column:
    return lookup(key, rules.identities)


def identity_message(key: Column, rules: NameRules = DEFAULT_RULES) -> Column:
    """``old -> new (reason)`` for an aliased key, null otherwise."""
    messages = {
        old: f"{old} -> {new}" + (f" ({rules.reasons[old]})" if rules.reasons.get(old) else "")
        for old, new in rules.identities.items() if old != new
    }
    if not messages:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in messages.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def normalize_names(df: DataFrame, column: str, rules: NameRules = DEFAULT_RULES,
                    identity_aliases: bool = False, prefix: str = "name") -> DataFrame:
    """Add ``{prefix}_raw``, ``_normalized``, ``_parent``, ``_alias_applied`` and ``_alias_reason``."""
    norm, parent = normalized_name(F.col(column), rules), parent_name(F.col(column), rules)
    out = df.withColumns({f"{prefix}_raw": stripped(F.col(column)), "_norm": norm, "_parent": parent})
    if identity_aliases:
        why = F.array_distinct(F.array_compact(F.array(
            identity_message(F.col("_parent"), rules), identity_message(F.col("_norm"), rules))))
        new_norm = identity_alias(F.col("_norm"), rules)
        new_parent = identity_alias(F.col("_parent"), rules)
    else:
        why = F.array().cast("array<string>")
        new_norm, new_parent = F.col("_norm"), F.col("_parent")
    return out.withColumns({
        f"{prefix}_normalized": new_norm,
        f"{prefix}_parent": new_parent,
        f"{prefix}_alias_reason": why,
        f"{prefix}_alias_applied": F.size(why) > 0,
    }).drop("_norm", "_parent")


def transform_stats(names: DataFrame, column: str, rules: NameRules = DEFAULT_RULES) -> DataFrame:
    """How many distinct names change by case folding, by dropping punctuation, by dropping words."""
    c = F.col(column)
    changed = {
        "casefold": c != folded(c),
        "punctuation_or_space_removed": folded(c).rlike("[^a-z0-9]"),
        "salt_or_drop_stripped": parent_name(c, rules) != normalized_name(c, rules),
    }
    distinct = names.select(column).where(c.isNotNull()).distinct()
    row = distinct.agg(F.count(F.lit(1)).alias("total"),
                       *[F.count_if(v).alias(k) for k, v in changed.items()])
    long = row.select("total", F.explode(F.array(*[
        F.struct(F.lit(k).alias("transform"), F.col(k).alias("count")) for k in changed])).alias("s"))
    return long.select("s.transform", "s.count",
                       F.when(F.col("total") > 0, F.col("s.count") / F.col("total")).otherwise(0.0).alias("rate"))
