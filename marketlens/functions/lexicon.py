"""Word lists as input: the library ships rules, its users bring the words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of one list at most that may become part of an expression; for longer ones see LexiconTables.
MOST_ENTRIES = 5_000


def entries(table: DataFrame, *columns: str, order: str = "ord") -> tuple:
    """The rows of a lexicon table in order, for the rules that take one; ValueError beyond MOST_ENTRIES."""
    rows = table.orderBy(order).select(*columns).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a lexicon has more than {MOST_ENTRIES} entries")
    return tuple(r[0] if len(columns) == 1 else tuple(r) for r in rows)


@dataclass(frozen=True)
class Words:
    """Words that matching looks for; none by default.

    colours: (name, pattern of the words for it), in order. accessories and
    bundles: words that make a name another kind of product. processors: families
    whose numbers and tiers are not the product's. colour_slots, storage_slots:
    what stores call these options of a variant, as patterns.
    """

    colours: tuple[tuple[str, str], ...] = ()
    accessories: tuple[str, ...] = ()
    bundles: tuple[str, ...] = ()
    processors: tuple[str, ...] = ()
    colour_slots: tuple[str, ...] = ()
    storage_slots: tuple[str, ...] = ()


@dataclass(frozen=True)
class Lexicon:
    """Words that the discovery rules look for.

    brands: known makers, in order. generic: kinds of product and small words,
    never a brand. rules: (category, subcategory, words joined by |), the first
    that fits decides. default: what is left. own_codes: prefixes of the numbers
    that stores give out themselves.
    """

    brands: tuple[str, ...] = ()
    generic: tuple[str, ...] = ()
    rules: tuple[tuple[str, str, str], ...] = ()
    default: tuple[str, str] = ("tjera", "Other")
    own_codes: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()
    families: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @staticmethod
    def from_tables(brands: DataFrame, generic: DataFrame, rules: DataFrame, stores: DataFrame) -> Lexicon:
        """brands and generic: ord, word; rules: ord, category, subcategory, words; stores: own_codes (array of prefixes)."""
        codes = stores.select(F.explode("own_codes").alias("code")).distinct().withColumn("ord", F.col("code"))
        return Lexicon(entries(brands, "word"), entries(generic, "word"), entries(rules, "category", "subcategory", "words"), own_codes=entries(codes, "code"))


@dataclass(frozen=True)
class LexiconTables:
    """The same words as tables of any size, which are joined and never become part of an expression.

    brands: ord, word; generic: word; rules: ord, category, subcategory, word
    (a row per word, plain text and no pattern).
    """

    brands: DataFrame
    generic: DataFrame
    rules: DataFrame
    default: tuple[str, str] = ("tjera", "Other")
    own_codes: tuple[str, ...] = ()
