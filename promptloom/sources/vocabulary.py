"""Vocabularies the generators draw from, and their dimension tables.

All of them are parameters: pass other lists to :class:`Vocabulary` and every
job draws from those. The built-in lists come from short word lists and rules: the first 311
products of the field rules and the first 293 of the table rules, so that 311 is a prime and
every step visits all fields. The type labels cover all branches of the type-dependent draws.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession

AGGREGATES = ("SUM", "AVG", "MIN", "MAX", "COUNT")

# Words the built-in names are made of.
_OWNERS = (
    "account", "asset", "billing", "branch", "campaign", "client", "contract", "course",
    "delivery", "device", "employee", "event", "invoice", "loan", "member", "payment",
    "project", "sensor", "shipment", "ticket",
)
_FIELD_NOUNS = (  # noun, SQL types, two synonyms of the noun
    ("id", ("INTEGER", "BIGINT", "UUID", "SERIAL", "BIGSERIAL", "SMALLINT"), ("identifier", "key")),
    ("name", ("VARCHAR(100)", "TEXT", "VARCHAR(50)", "VARCHAR(255)"), ("title", "label")),
    ("code", ("CHAR(8)", "VARCHAR(20)", "CHAR(2)", "VARCHAR(12)"), ("reference", "short_code")),
    ("status", ("VARCHAR(30)", "ENUM", "CHAR(1)", "VARCHAR(10)"), ("state", "condition")),
    ("amount", ("DECIMAL(10,2)", "NUMERIC", "DECIMAL(12,2)", "NUMERIC(10,2)", "NUMERIC(12,2)", "DECIMAL(15,2)"), ("sum_of_money", "volume")),
    ("price", ("DECIMAL", "FLOAT", "DECIMAL(8,2)", "NUMERIC(8,2)"), ("cost", "charge")),
    ("rate", ("FLOAT", "DOUBLE", "DECIMAL(5,4)", "DECIMAL(5,2)"), ("ratio", "pace")),
    ("date", ("DATE", "DATETIME", "YEAR"), ("day", "calendar_day")),
    ("moment", ("TIMESTAMP", "DATETIME", "TIME", "INTERVAL"), ("point_in_time", "instant")),
    ("tally", ("INTEGER", "BIGINT", "SMALLINT", "NUMERIC(10)"), ("number", "how_often")),
    ("note", ("TEXT", "LONGTEXT", "MEDIUMTEXT", "VARCHAR(1000)"), ("remark", "comment")),
    ("flag", ("BOOLEAN", "TINYINT(1)"), ("marker", "switch")),
    ("token", ("UUID", "CHAR", "CHAR(64)", "VARCHAR(64)"), ("secret_key", "handle")),
    ("payload", ("JSON", "JSONB", "BLOB", "BYTEA", "BINARY", "TEXT"), ("content", "body")),
    ("score", ("NUMERIC(5,2)", "DOUBLE", "NUMERIC(3,1)", "DECIMAL(4,1)"), ("grade", "points")),
    ("city", ("VARCHAR", "POINT", "GEOMETRY", "POLYGON", "INET", "VARCHAR(80)"), ("town", "place")),
)
_TABLE_AREAS = (
    "archived", "current", "daily", "external", "foreign", "global", "internal", "local",
    "monthly", "new", "online", "open", "pending", "public", "regional", "remote", "shared",
    "weekly", "yearly",
)
_TABLE_KINDS = (  # plural, another word for it
    ("accounts", "customer_files"), ("bookings", "reservations"), ("cases", "matters"),
    ("deals", "agreements"), ("devices", "machines"), ("grants", "funds"),
    ("journals", "logbooks"), ("meetings", "appointments"), ("notices", "announcements"),
    ("parcels", "packages"), ("reports", "write_ups"), ("returns", "sent_back_goods"),
    ("surveys", "questionnaires"), ("tasks", "to_dos"), ("visits", "calls"),
    ("workshops", "classes"),
)
_FIELD_COUNT = 311  # prime: every step from 1 to 310 visits all fields
_TABLE_RULE_COUNT = 293
_SHARED_NAME_STEP = 29  # every 29th field name is a table name too

_SELECT_VERBS = (
    "show me", "list", "display", "fetch", "get", "read", "return", "retrieve", "find",
    "print", "extract",
)
_SELECT_FRAMES = (
    "{verb} [fields] from [table]", "{verb} [fields] in [table]", "from [table] {verb} [fields]",
    "please {verb} [fields] of [table]", "could you {verb} [fields] from [table]?",
)
_ORDER_VERBS = ("sorted", "ordered", "arranged", "ranked", "listed", "organised", "sequenced")
_ASC_FRAMES = (
    "{verb} by", "{verb} upwards by", "{verb} in ascending order of",
    "{verb} in rising order of", "{verb} from low to high by", "{verb} from first to last by",
    "{verb} with the smallest first by",
)
_DESC_FRAMES = (
    "{verb} downwards by", "{verb} in descending order of", "{verb} from high to low by",
)
_DESC_EXTRA = ("newest first by", "with the largest first by")
_AGG_WORDS = {  # phrases are a head word, alone or with an ending
    "SUM": (("total", "sum", "combined", "overall", "whole", "cumulative", "joint", "full",
             "added up", "accumulated"), ("", " amount of")),
    "AVG": (("average", "mean", "typical", "usual", "expected", "normal", "middle"),
            ("", " value of", " level of")),
    "MIN": (("minimum", "lowest", "smallest", "least", "tiniest", "bottom", "shortest",
             "earliest", "min", "slightest"), ("", " value of")),
    "MAX": (("maximum", "highest", "largest", "greatest", "biggest", "top", "max"),
            ("", " value of")),
    "COUNT": (("count", "number", "tally", "frequency", "how many"),
              ("", " of", " of all")),
}


def _fields() -> list[tuple[str, list[str], list[str]]]:
    rows = [
        (f"{owner}_{noun}", list(types), [f"{owner}_{syn}" for syn in synonyms])
        for owner, (noun, types, synonyms) in product(_OWNERS, _FIELD_NOUNS)
    ]
    return rows[:_FIELD_COUNT]


def _tables() -> list[tuple[str, list[str]]]:
    rows = [
        (f"{area}_{kind}", [f"{area}_{other}", f"{kind}_marked_{area}"])
        for area, (kind, other) in product(_TABLE_AREAS, _TABLE_KINDS)
    ][:_TABLE_RULE_COUNT]
    shared = [
        (name, [f"table_of_{synonyms[0]}", f"{synonyms[1]}_list"])
        for name, _, synonyms in _fields()[::_SHARED_NAME_STEP]
    ]
    return rows + shared


@dataclass(frozen=True)
class Vocabulary:
    """Word lists of the item generators."""

    fields: list = field(default_factory=_fields)  # (name, types, synonyms)
    tables: list = field(default_factory=_tables)  # (name, synonyms)
    select_templates: list = field(
        default_factory=lambda: ["SELECT [fields] FROM [table]"]
        + [f.format(verb=v) for v in _SELECT_VERBS for f in _SELECT_FRAMES]
    )
    order_phrases: list = field(  # (phrase, ascending)
        default_factory=lambda: [
            (f.format(verb=v), True) for v in _ORDER_VERBS for f in _ASC_FRAMES
        ]
        + [(f.format(verb=v), False) for v in _ORDER_VERBS for f in _DESC_FRAMES]
        + [(p, False) for p in _DESC_EXTRA]
    )
    agg_phrases: dict = field(
        default_factory=lambda: {
            agg: [head + tail for head in heads for tail in tails]
            for agg, (heads, tails) in _AGG_WORDS.items()
        }
    )

    def asc_phrases(self) -> list[str]:
        return [p for p, asc in self.order_phrases if asc]

    def desc_phrases(self) -> list[str]:
        return [p for p, asc in self.order_phrases if not asc]


DEFAULT = Vocabulary()


@dataclass(frozen=True)
class PairVocabulary:
    """Short words (one token each in small models) for clean/corrupt pairs."""

    tables: dict = field(  # name → synonym
        default_factory=lambda: {
            "books": "novels", "teams": "crews", "rooms": "chambers", "songs": "tunes",
            "cars": "vehicles", "games": "matches", "shops": "stores",
        }
    )
    novel_tables: tuple = ("river", "green", "moon", "bread", "quick")
    fields: dict = field(
        default_factory=lambda: {
            "volume": "loudness", "cost": "price", "score": "points", "height": "tallness",
            "width": "breadth", "length": "extent", "floor": "storey", "badge": "emblem",
            "kind": "sort", "state": "condition", "city": "town", "email": "mail",
            "phone": "line", "month": "period", "brand": "make", "group": "set",
            "model": "version", "speed": "pace",
        }
    )
    novel_fields: tuple = ("window", "happy", "tiger", "cloud", "purple")
    types: tuple = ("INT", "CHAR", "TIME", "TEXT", "JSON")
    # Words that stand in for a field in a prompt.
    random_words: tuple = (
        "ball", "bird", "boat", "cake", "coat", "door", "duck", "farm", "fish", "frog",
        "hat", "lake", "leaf", "milk", "ring", "road", "rock", "seed", "ship", "snow",
    )


PAIRS = PairVocabulary()


# ---------------------------------------------------------------- dimension tables
def field_table(spark: SparkSession, vocab: Vocabulary = DEFAULT) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(vocab.fields)]
    return spark.createDataFrame(
        rows, "idx int, name string, types array<string>, synonyms array<string>"
    )


def table_table(spark: SparkSession, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Table names; synonyms read as words (underscores become spaces)."""
    rows = [(i, n, [s.replace("_", " ") for s in syn]) for i, (n, syn) in enumerate(vocab.tables)]
    return spark.createDataFrame(rows, "idx int, name string, synonyms array<string>")


def template_table(spark: SparkSession, vocab: Vocabulary = DEFAULT) -> DataFrame:
    return spark.createDataFrame(
        list(enumerate(vocab.select_templates)), "idx int, template string"
    )


def order_phrase_table(spark: SparkSession, vocab: Vocabulary = DEFAULT) -> DataFrame:
    rows = [(i, phrase, asc) for i, (phrase, asc) in enumerate(vocab.order_phrases)]
    return spark.createDataFrame(rows, "idx int, phrase string, asc boolean")


def agg_phrase_table(spark: SparkSession, vocab: Vocabulary = DEFAULT) -> DataFrame:
    rows = [(agg, i, p) for agg, ps in vocab.agg_phrases.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "agg string, idx int, phrase string")


def vocabulary_sizes(spark: SparkSession, vocab: Vocabulary = DEFAULT) -> DataFrame:
    """One row per vocabulary with its size, and the product of all of them."""
    from pyspark.sql import functions as F

    parts = {
        "fields": field_table(spark, vocab),
        "tables": table_table(spark, vocab),
        "select_templates": template_table(spark, vocab),
        "order_phrases": order_phrase_table(spark, vocab),
        "agg_phrases": agg_phrase_table(spark, vocab),
    }
    rows = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("vocabulary"))
        rows = one if rows is None else rows.unionByName(one)
    sizes = rows.groupBy("vocabulary").agg(F.count("*").alias("size"))
    whole = sizes.agg(
        F.lit("product").alias("vocabulary"),
        F.aggregate(F.collect_list("size"), F.lit(1).cast("bigint"), lambda a, b: a * b).alias(
            "size"
        ),
    )
    return sizes.unionByName(whole)
