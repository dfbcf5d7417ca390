"""Licence notices found in texts, with Spark's own functions only."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHINGLE = 5
#: Bands, as bits of a hash, of a window's signature for notices of 1, of 2 or 3, and of more shingles. One
#: permutation puts every shingle in a band, and the smallest hash of each band is a row of the
#: signature. Windows hold three times the blocks of a notice's size class, so a text with four fifths of
#: its shingles in a row has a window with a Jaccard similarity of 0.25 or more, and the two
#: agree in no band with a probability of under 0.0002 (a test draws the cases), while a notice of 50 shingles
#: of which the window has one is not looked at four times out of ten, and one of 200 nine times.
BAND_BITS = (14, 8, 6)
#: Share of a notice's distinct shingles that a text must hold, in fifths.
FIFTHS = 4

# Licence notices. Families that differ by name or version are filled in.
_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} "
    "as published by the Free Software Foundation; {which} of the License, or (at your option) any later version."
)
_GNU_NAMES = {"gpl": "General Public License", "lgpl": "Lesser General Public License", "agpl": "Affero General Public License"}
_GNU_VERSIONS = {"gpl": ("2", "3"), "lgpl": ("2.1", "3"), "agpl": ("3",)}
_CC_NAMES = {
    "by": "Attribution",
    "by-sa": "Attribution-ShareAlike",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: {first}Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. {second}Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution. "
)
_BSD_THIRD = (
    "{third}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_NUMBERED = {"first": "1. ", "second": "2. ", "third": "3. "}
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
    "file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
    "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met",
    "bsd-2-clause": _BSD.format(**_NUMBERED) + _BSD_END,
    "bsd-3-clause": _BSD.format(**_NUMBERED) + _BSD_THIRD.format(**_NUMBERED) + _BSD_END,
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring "
    "rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the Software), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software.",
}
for _short, _versions in _GNU_VERSIONS.items():
    for _version in _versions:
        _id, _name = f"{_short}-{_version if '.' in _version else _version + '.0'}", _GNU_NAMES[_short]
        NOTICES[_id] = f"This work is licensed under the GNU {_name}, version {_version}."
        _what = "library" if _short == "lgpl" else "program"
        NOTICES[f"{_id}-header"] = _GNU.format(what=_what, name=_name, which=f"either version {_version}")
        NOTICES[f"{_id}-only-header"] = (
            f"under the terms of the GNU {_name} as published by the Free Software Foundation, version {_version} of the License."
        )
for _short, _name in _CC_NAMES.items():
    NOTICES[f"cc-{_short}-4.0"] = f"This work is licensed under a Creative Commons {_name} 4.0 International License."
    NOTICES[f"cc-{_short}-3.0"] = f"This work is licensed under a Creative Commons {_name} 3.0 Unported License."
    NOTICES[f"cc-{_short}-4.0-short"] = f"Licensed under CC {_short.upper()} 4.0."
# Letters that change and, after them, punctuation that goes.
FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?()\"'"
TO = "abcdefghijklmnopqrstuvwxyz"
#: A word of these alone is a mark of a comment or a rule, and no word.
MARKS = "*#/-;%<>|=~_+"
_BLANK = " \t\n\x0b\f\r"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, though functions of elements refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column) -> Column:
    """Hashes of the runs of five words of a text, in order; none if it has fewer words."""
    plain = F.btrim(F.translate(F.coalesce(text.cast("string"), F.lit("")), FROM, TO), F.lit(_BLANK))
    own = F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: F.translate(w, MARKS, "") != "")
    words = F.transform(own, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE, F.lit(0)))
        run = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, run).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _bound(words, runs)


def bits_of(size_class: int) -> int:
    return BAND_BITS[min(size_class, len(BAND_BITS) - 1)]


def band_minima(hashes: Column, bits: int) -> Column:
    """The smallest hash of every band that a set of hashes has a member in."""

    def smallest(ordered: Column) -> Column:
        band = lambda x: F.shiftright(x, 64 - bits)
        return F.filter(ordered, lambda x, i: (i == 0) | (band(x) != band(F.get(ordered, i - 1))))

    return _bound(F.sort_array(hashes), smallest)


def window_keys(hashes: Column, size_class: int) -> Column:
    """The band minima of all windows of a text for notices of 2^c up to 2^(c+1) - 1 shingles, in one array.

    A window is three blocks of 2^c shingles, and one begins with every block.
    """
    block, bits = 1 << size_class, bits_of(size_class)

    def every(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1)), F.lit(block))
        return F.flatten(F.transform(starts, lambda s: band_minima(F.slice(h, s, F.lit(3 * block)), bits)))

    return _bound(hashes, every)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.expr("cast(array() as array<bigint>)")


def _templates(spark: SparkSession, notices: dict[str, str]) -> list[tuple[str, list[int], int, list[int]]]:
    """Name, distinct shingles, size class and band minima of every notice of five words or more."""
    own = F.array_distinct(shingles(F.col("notice")))
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("notice")) for n, t in sorted(notices.items())])
    rows = spark.range(1).select(F.inline(listed)).select("name", own.alias("own"))
    size_class = F.floor(F.log2(F.size("own"))).cast("int")
    minima = F.lit(None).cast("array<bigint>")
    for c in range(20):
        minima = F.when(size_class == c, band_minima(F.col("own"), bits_of(c))).otherwise(minima)
    rows = rows.filter("size(own) > 0").select("name", "own", size_class, minima)
    return [tuple(r) for r in rows.collect()]


def find_notices(
    docs: DataFrame, notices: dict[str, str] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, license, n_shared, n_notice, first_word) of the notices that a text holds.

    Words are compared in lower case (A-Z) without punctuation; what consists of comment marks alone
    is no word, so a notice may stand in a block of comments. A text that has a shingle of five words in common
    with any notice is cut into overlapping windows, by the size class of notices, and each window has a
    one-permutation MinHash signature (see ``BAND_BITS``). A notice is looked at if it agrees with a window
    in a band, and reported if the whole text holds at least four fifths of its distinct shingles, and
    of those that each other notice of the list lacks: so a notice is told from others that differ in a name or a
    version. One that is part of another is reported beside it. ``first_word`` is the number, from 0,
    of the word that the first shared shingle begins with.

    All of it happens in the row: notices are a fixed list, so nothing is shuffled and hot sources or copies make
    no difference. Null, empty and short texts hold nothing, a text of any length is scanned as a whole. A text is reported once for
    each notice; rows with null or repeated keys are searched each; other columns play no part. A list
    without a notice of five words, and an empty table, give no rows.
    """
    found = _templates(docs.sparkSession, NOTICES if notices is None else notices)
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), shingles(F.col(f"`{text}`")).alias("own"))
    near = source.filter(F.arrays_overlap("own", _longs(sorted({h for _, own, _, _ in found for h in own}))))
    kind = "struct<license:string,class:int,notice:array<bigint>,wanted:array<bigint>,apart:array<array<bigint>>>"
    rows = []
    for name, own, size_class, minima in found:
        others = [set(other) for n, other, _, _ in found if n != name and set(own) & set(other)]
        apart = {tuple(h for h in own if h not in other) for other in others} - {()}
        parts = F.array(*[_longs(list(a)) for a in sorted(apart)]) if apart else F.expr("cast(array() as array<array<bigint>>)")
        rows.append(
            F.struct(
                F.lit(name).alias("license"), F.lit(size_class).alias("class"), _longs(own).alias("notice"),
                _longs(minima).alias("wanted"), parts.alias("apart"),
            )
        )
    listed = F.array(*rows) if rows else F.expr(f"cast(array() as array<{kind}>)")
    classes = sorted({c for _, _, c, _ in found})
    keyed = near.select(
        "doc_id", "own", *[window_keys(F.col("own"), c).alias(f"keys_{c}") for c in classes]
    )
    held = F.lit(False)
    for c in classes:
        held = F.when(F.col("t.class") == c, F.arrays_overlap(f"keys_{c}", "t.wanted")).otherwise(held)
    retrieved = keyed.select("*", F.explode(listed).alias("t")).filter(held).select("doc_id", "own", "t.*")
    shared = retrieved.withColumn("both", F.array_intersect("own", "notice"))
    enough = lambda part, whole: 5 * part >= FIFTHS * whole
    told = F.forall("apart", lambda a: enough(F.size(F.array_intersect("both", a)), F.size(a)))
    first = _bound(F.col("own"), lambda own: F.array_min(F.transform("both", lambda x: F.array_position(own, x)))) - 1
    return shared.filter(enough(F.size("both"), F.size("notice")) & told).select(
        "doc_id",
        "license",
        F.size("both").cast("long").alias("n_shared"),
        F.size("notice").cast("long").alias("n_notice"),
        first.alias("first_word"),
    )
