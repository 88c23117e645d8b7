"""License scans by canonical digest lookup, with DataFrame functions only.

A text is made canonical line by line: lower case, equivalent spellings made one, everything but letters and digits (of any
script) to spaces, copyright lines and blank lines left out. ``(c)`` begins a copyright line only before a year or the
word, as clauses are lettered, too. Its entire canonical text is looked up by digest among known license
texts that were made canonical in the same way. Since notices are often put into other documents, each paragraph and each
line is looked up as an entire text too. Only texts whose canonical length is that of some known text are digested, which
leaves nothing out, and only digests are joined.

Nulls and ties: null, empty and blank texts match nothing, nor do texts of copyright lines alone. Two known texts with one
canonical form are both reported. Rows that are equal in id and text come back as often as they came; null ids are kept.
Known licenses with a null id or text are ignored. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Spellings that licence guidelines treat as the same word, left to right.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub-license", "sublicense"), ("noncommercial", "non commercial"), ("copyright holder", "copyright owner"),
    ("favour", "favor"), ("organisation", "organization"), ("behaviour", "behavior"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("per cent", "percent"),
    ("https", "http"), ("version ", "v "),
]

# Short notices and texts of public licenses, by identifier. Longer texts can be given as a table.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

# The parts of texts that several licenses share.
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
)
_PERMISSIONS = {k: t for k, t in NOTICES if k in ("ISC", "0BSD")}

#: Short licenses whole, each also below its title.
TEXTS = {
    "MIT": ("MIT License", NOTICES[-1][1]),
    "BSD-2-Clause": ("BSD 2-Clause License", "\n\n".join([_REDISTRIBUTION, _SOURCE, _BINARY, _DISCLAIMER])),
    "BSD-3-Clause": ("BSD 3-Clause License", "\n\n".join([_REDISTRIBUTION, _SOURCE, _BINARY, _NAMES, _DISCLAIMER])),
    "ISC": ("ISC License", f"{_PERMISSIONS['ISC']}\n\n{_ISC}"),
    "0BSD": ("BSD Zero Clause License", f"{_PERMISSIONS['0BSD']}\n\n{_ISC}"),
}

#: Canonical digests and lengths of long licenses: whole, and with and without the line that ends their terms where an
#: appendix follows. A text doesn't tell whether later versions may be used too, so the GNU ones have their plain version.
DIGESTS = [
    ("Apache-2.0", 8826, "47185d22d70d9cfd022188186985a733cf9d92f28aed25dc9b075975aaef0b8f"),
    ("Apache-2.0", 8854, "f5904e151a34676d4e72ff4da1cc932f26500c419a30b1a8da2a4ab891ee34a8"),
    ("Apache-2.0", 9864, "30f252879a369658fc224e8227e895b73379d4925f9a2e6ca76cd07f39c6a303"),
    ("Artistic-1.0-Perl", 5787, "bb44dfea0e08b5df86428cd5c83bbcd4ab3485542eff65f9cc769e7db74ca598"),
    ("BSD-3-Clause", 1361, "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", 6686, "92f195ae84ff559b03177551e6c1166f57d3cc30f5a7d806b4039e24906bd8de"),
    ("GFDL-1.2", 19397, "8cfd7d0a38d3371a9b3ca36b20623ab4d56d1b6dfc7de4cecb7c8eb0043c3264"),
    ("GFDL-1.3", 21814, "56d05bb25dfeb6a3f4add094b70ccc9cd89de776cb86eac3192ff118476e4c25"),
    ("GPL-1.0", 9325, "b46d2ebfb9c2ad738177f2b3270c6cc977494c832df21f87bb99335f513bfcd0"),
    ("GPL-1.0", 9353, "b3f4c8c3fd2c5a465250670671e45d06a9efd88261ab51de2ab179527e73f362"),
    ("GPL-1.0", 11628, "bca402dd3c74a0f5fa60b989e86b782749f524286ee27b25864d26cb1bed0bf2"),
    ("GPL-2.0", 14392, "c7ccd6e683ed291cd83625be15b3824eeec568ba3648cff39a3cbda0da5ee0a0"),
    ("GPL-2.0", 14420, "e68d68cc0de6fd440c1bd8753a6e50e50a2387f17b43f75e15b677d1a2725ddd"),
    ("GPL-2.0", 17042, "5f42b425ea4cc957d3d2f66d7328073a570c4618ef2e00c1a04929762ff8dcf7"),
    ("GPL-3.0", 30683, "e3cbcce11225d15a6d9ec48b7e0060ed6e408b6812e9ed5745f77ad959eee0a4"),
    ("GPL-3.0", 30711, "c9662f84191b695f6a64c6c39533b59e6d37c2fa252f6f3c4dcaab57f2d1f581"),
    ("GPL-3.0", 33143, "939cd0e84835ef005e0af0c5f5cbda671550efdf8f7e57c2238e0cee1361d900"),
    ("LGPL-2.0", 22149, "24c4be4721d7517c273351f85b2c20b8c1fea7f0cba7f245a3137b8387bbbbb6"),
    ("LGPL-2.0", 22177, "1d1a06814ba23fc0fec1e3b901896c967b4de59fabb8f66af769424faa2b0b8d"),
    ("LGPL-2.0", 23961, "376c5705077f8b8b8bf6e88c53b90eea3ad0e990d0a3400a404ecb1a645ee9f0"),
    ("LGPL-2.1", 23201, "7abd8b5006751628ae8a8fb3183d36d677b4009fd7dfbb7b433eed090b133ac0"),
    ("LGPL-2.1", 23229, "99a1c031e4ee69a0535512462c0e344fc887c3552c3836b712504515f060d7f7"),
    ("LGPL-2.1", 25012, "c29dc70f4feb9651eaa5d7fa814cfb5b8a2d1fb28faea542530c02463087e98f"),
    ("LGPL-3.0", 6990, "150d84303009e3c33d11663bc3fdfc1c544ddb01f5527f42cc9004f1d425f463"),
    ("MPL-1.1", 22231, "889542d0859a996018eb30abfc0aa2688eb64b34c5b4dda5acad80eecb8f0c2e"),
    ("MPL-2.0", 14269, "b75288d3e33fff84171007912e95102fe4dd891052e0a947ca733057da32eb65"),
]

_COPYRIGHT = r"^[^a-z0-9]*(copyright\\b(?! holder| owner| notice| license| law)|\\(c\\)\\s*(copyright\\b|[0-9]{4}\\b)|©|all rights reserved)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def canonical_line(line: str) -> str:
    """SQL text of a line's canonical form, empty where it is blank or a copyright line."""
    out = f"lower({line})"
    plain = f"trim(regexp_replace({out}, '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"
    for a, b in SPELLINGS:
        a = a.replace("-", " ")
        plain = f"replace({plain}, {_quoted(a)}, {_quoted(b)})"
    return f"if({out} RLIKE '{_COPYRIGHT}', '', {plain})"


def with_units(df: DataFrame, text: str) -> DataFrame:
    """Adds ``units``: an array of structs (kind, canonical)."""
    lines = F.expr(f"transform(split(`{text}`, '\\n', -1), l -> {canonical_line('l')})")
    blank = F.expr(f"transform(split(`{text}`, '\\n', -1), l -> trim(l) = '')")
    out = df.withColumn("__l", F.explode(F.array(F.struct(lines.alias("c"), blank.alias("blank")))))
    # Paragraphs: blank lines become line feeds, the rest is joined by spaces and split again.
    joined = F.expr("array_join(zip_with(__l.c, __l.blank, (c, b) -> if(b, '\\n', c)), ' ')")
    squeezed = F.expr("trim(regexp_replace(array_join(filter(__l.c, c -> c <> ''), ' '), ' +', ' '))")
    paragraphs = F.expr(r"transform(split(__joined, '\n', -1), p -> trim(regexp_replace(p, ' +', ' ')))")
    out = out.withColumn("__joined", F.explode(F.array(joined)))
    kind = lambda k, a: F.transform(a, lambda c: F.struct(F.lit(k).alias("kind"), c.alias("canonical")))
    every = F.concat(kind("text", F.array(squeezed)), kind("paragraph", paragraphs), kind("line", F.expr("__l.c")))
    return out.withColumn("units", F.filter(F.coalesce(every, F.array()), lambda u: u["canonical"] != "")).drop("__l", "__joined")


def known_digests(known: DataFrame) -> DataFrame:
    """``(digest, length, license)`` of known texts ``(license, text)``."""
    whole = with_units(known.filter("license IS NOT NULL AND text IS NOT NULL"), "text").select("license", F.explode("units").alias("u")).filter("u.kind = 'text'")
    return whole.select(F.sha2(F.col("u.canonical").cast("binary"), 256).alias("digest"), F.length("u.canonical").alias("length"), "license").distinct()


def notices(spark: SparkSession) -> DataFrame:
    whole = [(k, t) for k, (title, text) in TEXTS.items() for t in (text, f"{title}\n\n{text}")]
    return spark.createDataFrame(NOTICES + whole, "license string, text string")


def built_in(spark: SparkSession) -> DataFrame:
    """``(digest, length, license)`` of all licenses that are known without a table."""
    long = spark.createDataFrame([(d, n, k) for k, n, d in DIGESTS], "digest string, length int, license string")
    return known_digests(notices(spark)).unionByName(long).distinct()


def license_scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``(doc_id, whole, parts, n_lines)``: licenses its entire text is, licenses of its paragraphs and lines
    (both sorted), and the number of distinct known lines."""
    digests = built_in(docs.sparkSession) if known is None else known_digests(known)
    lengths = [r[0] for r in digests.select("length").distinct().collect()]  # not more than there are known texts
    source = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    parts = with_units(source, "text").select("doc", "body", "units")
    fitting = F.array_distinct(F.filter("units", lambda u: F.length(u["canonical"]).isin(lengths)))
    # One row per text to look up, and one without a digest that stands for the document.
    hashed = F.transform(fitting, lambda u: F.struct(u["kind"].alias("kind"), F.sha2(u["canonical"].cast("binary"), 256).alias("digest")))
    own = F.array(F.struct(F.lit("document").alias("kind"), F.concat(F.lit("none "), F.xxhash64("doc", "body").cast("string")).alias("digest")))
    rows = parts.select("doc", "body", F.explode(F.concat(hashed, own)).alias("u")).select("doc", "body", "u.*")
    met = rows.join(digests.select("digest", "license"), "digest", "left")
    found = met.groupBy("doc", "body").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "text", F.col("license")))).alias("whole"), F.array_sort(F.collect_set("license")).alias("parts"),
        F.collect_set(F.when((F.col("kind") == "line") & F.col("license").isNotNull(), F.col("digest"))).alias("lines"), F.count(F.when(F.col("kind") == "document", 1)).alias("copies"),
    )
    return found.select(F.col("doc").alias(doc_id), "whole", "parts", F.size("lines").cast("bigint").alias("n_lines"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
