"""Fixed schemas of the files the library reads and writes."""

from pyspark.sql import types as T

# Column order of the published mention files; the unlabeled file has no *-coref columns.
_MENTION_COLUMNS = [
    ("ID", T.StringType()),
    ("Text", T.StringType()),
    ("Pronoun", T.StringType()),
    ("Pronoun-offset", T.IntegerType()),
    ("A", T.StringType()),
    ("A-offset", T.IntegerType()),
    ("A-coref", T.BooleanType()),
    ("B", T.StringType()),
    ("B-offset", T.IntegerType()),
    ("B-coref", T.BooleanType()),
    ("URL", T.StringType()),
]

# File column -> column name used by every operator.
COLUMN_NAMES = {
    "ID": "id",
    "Text": "text",
    "Pronoun": "pronoun",
    "Pronoun-offset": "p_off",
    "A": "a",
    "A-offset": "a_off",
    "A-coref": "a_coref",
    "B": "b",
    "B-offset": "b_off",
    "B-coref": "b_coref",
    "URL": "url",
}


def mention_schema(labeled: bool = True) -> T.StructType:
    return T.StructType(
        [
            T.StructField(name, kind)
            for name, kind in _MENTION_COLUMNS
            if labeled or not name.endswith("-coref")
        ]
    )


# File column -> column name, in file order.
PREDICTION_NAMES = {"A": "pr_a", "B": "pr_b", "NEITHER": "pr_neither", "ID": "id"}

_PROBABILITIES = [T.StructField(c, T.DoubleType()) for c in ("A", "B", "NEITHER")]
_ID = T.StructField("ID", T.StringType())
TEMPLATE = T.StructType([_ID, *_PROBABILITIES])
PREDICTION = T.StructType([*_PROBABILITIES, _ID])

LEXICON = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("gender", T.IntegerType())]
)

TOKEN_VECTORS = T.StructType(
    [
        T.StructField("row_key", T.StringType()),
        T.StructField("linex_index", T.LongType()),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("token", T.StringType()),
                        T.StructField(
                            "layers",
                            T.ArrayType(
                                T.StructType(
                                    [T.StructField("values", T.ArrayType(T.DoubleType()))]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
