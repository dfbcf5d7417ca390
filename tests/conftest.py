import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from antecede.session import local_session  # noqa: E402

TEXT = "Bob Lee saw Ann. Then he left."


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture()
def mentions(spark):
    """Mention rows from (text, pronoun, a, b) with offsets of the first whole-word match."""

    def find(text, word):
        return re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text).start()

    def build(rows, **extra):
        out = []
        for i, (text, pronoun, a, b) in enumerate(rows):
            out.append(
                {
                    "id": i,
                    "text": text,
                    "pronoun": pronoun,
                    "p_off": find(text, pronoun),
                    "a": a,
                    "a_off": find(text, a),
                    "b": b,
                    "b_off": find(text, b),
                    "a_coref": i % 3 == 0,
                    "b_coref": i % 3 == 1,
                    "url": "http://x/y/Bob_Lee",
                    **extra,
                }
            )
        return spark.createDataFrame(
            out,
            "id long, text string, pronoun string, p_off int, a string, a_off int, b string, b_off int, "
            "a_coref boolean, b_coref boolean, url string",
        )

    return build


@pytest.fixture()
def one(mentions):
    return mentions([(TEXT, "he", "Ann", "Bob Lee")])
