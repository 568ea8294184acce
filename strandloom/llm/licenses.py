"""Licence scan by canonical digests, in DataFrame operations only.

A text is normalised (case, copyright lines, punctuation, spellings that count as equal) and
hashed; entire texts are then joined to the digests of known licences. The known table is a
constant of this module, so its broadcast is bounded; a larger registry given as a DataFrame is
joined by an ordinary hash join.

A null text counts as empty, whose digest belongs to no licence. Rows with equal or null doc_id
are judged one by one; texts of any length are hashed whole; of licences with equal digests the least name is
given; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Spellings that count as equal, after punctuation is gone; applied in this order.
SPELLINGS = (
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authoris", "authoriz"),
    ("behaviour", "behavior"), ("catalogue", "catalog"), ("centre", "center"), ("colour", "color"), ("defence", "defense"), ("favour", "favor"),
    ("honour", "honor"), ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"), ("merchantability", "merchantibility"),
    ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"), ("organis", "organiz"), ("per cent", "percent"),
    ("programme", "program"), ("recognis", "recogniz"), ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"),
    ("copyright owner", "copyright holder"), ("https", "http"),
)
COPYRIGHT = r"\n[ \t*#/;%-]*(copyright[ \t,]*(\(c\)|©)?|\(c\)|©)[ \t,]*([0-9]{4}|<year>|\[year\]|\[yyyy\])[^\n]*"
RESERVED = r"\n[ \t*#/;%-]*all rights reserved\.?[ \t]*"
LINE = "(?i)licen[cs]"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Public licence texts and notices.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_UNLICENSE = "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
LICENSES = {
    "MIT": "MIT License\nCopyright (c) <year> <holder>\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS,
    "MIT-0": "MIT No Attribution\nCopyright <year> <holder>\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n" + _AS_IS,
    "ISC": "ISC License\nCopyright (c) <year> <holder>\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_AS_IS,
    "BSD-2-Clause": "Copyright (c) <year> <holder>\n" + _BSD_HEAD + _BSD_AS_IS,
    "BSD-3-Clause": "Copyright (c) <year> <holder>\n" + _BSD_HEAD + _BSD_THIRD + _BSD_AS_IS,
    "Zlib": "zlib License\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": _UNLICENSE + '\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n' + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + "\n\nFor more information, please refer to <https://unlicense.org>",
    "Unlicense (part)": _UNLICENSE,
    "Apache-2.0 (notice)": 'Copyright [yyyy] [name]\nLicensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "MIT (line)": "Released under the MIT License.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
}

# Canonical digests of entire texts, as /usr/share/common-licenses has them. Of a text with an appendix on how
# to apply it, also without that appendix, with and without the line that ends the terms.
DIGESTS = {
    "Apache-2.0": ("1ec8944c2775d3bd34bb84718368de66c90754b56400be3d60db25ad7da05a8d", "5d47a1e0ee1897664039daef76a67d9ba33e6c72ff1c68bd3f3d75fac102186b", "6e644cfbb36f246cb676ca98debb803309c9f71d76d5a9946d24badb59faa6b9",),
    "CC0-1.0": ("5ae3f76dda2e69e50143522ea539402a0b5e33eb1a4ba0497fc88f282d5c0d33",),
    "GFDL-1.2": ("24a668c9e3fb6a8186f46c6a4eaaf14ee1a1f96f57f74b91ab2bdac712581b9d",),
    "GFDL-1.3": ("75c632ea5d8952669a1d595cafa1ba48ef8956e48479d9f234e1b803f3bb3a65",),
    "GPL-1.0": ("0fc9f0adca24b09dbf2f15cb30fbdc54e5569eaa5593d15621751c82119ce36b", "3be3e8599c6ca7f54ea16afdb28c9d91ec9dbe2c1d376b4d77ae2d253e0b5f3f", "87ea78588df37871aa01b1f4fb7269fbceae1e4726f173ff578e3c91438594d3",),
    "GPL-2.0": ("c80373d123f336d4dcb3bd3369c4aa7b194a530b4ca4d172a8c7a53ed69e9370", "ec1274b0793c2f20a3e103092f408d5e47a9c0d7baef1c81dd0fe02949e7366b", "f4bf064c732e2de7bfda8a2e84bd2574e97734cc9eacb52de5934ac8eac8a6fa",),
    "GPL-3.0": ("5c01a1ce9ca38d5359cf75172ebe30367c8fd7790746891cbdbcc006400b5a38", "a64051d9bbdbd73a4f9f170cb5f8795bf0193f418602d911089265f14ed23338", "fc845711600c549f75346f311100b13a592529117e744c8cb33055af6987588c",),
    "LGPL-2.0": ("693c6bcd9fb9499cf6b76cabc0ea65dc93500f051ac90fc734d0532775f5fa5f", "aa1485fda742a1f4f473d6a85765624c52b38b806216fd012cc95b20370945e3", "ec036278e9ca8601df084497508a8c841d329cfd96d7d4e50b6d5476a1092484",),
    "LGPL-2.1": ("4f2cbda02411952b6b7580c8ddf9d33f5df744decaafceb63e632e7e16dbb7e3", "82f45d1d7f7a74e36ec8b8715c6bdcb6fac320e11cf6bbc7cad59a255da3c7bb", "daf7f0705812170c5cb7dc4b46d00aa784f3234b442a0b67e2e7fc754d8a9ea5",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",),
    "MPL-2.0": ("6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",),
}
#: A line without these words is none of the above; every text has one of them, and no spelling makes one.
WORDS = "(?i)licen[cs]|software"
# What the SQL knows: the texts above by their former names, without the digests and the entire Unlicense, and on lines with LINE only.
_SQL_TEXTS = {k.removesuffix(" (part)").removesuffix(" (notice)"): v for k, v in LICENSES.items() if k != "Unlicense"}


def canonical(text: Column) -> Column:
    """The text that is hashed."""
    c = F.concat(F.lit("\n"), F.translate(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\r"), F.lit("\n")), _UPPER, _LOWER))
    c = F.regexp_replace(F.regexp_replace(c, COPYRIGHT, ""), RESERVED, "")
    c = F.btrim(F.regexp_replace(c, PUNCTUATION, " "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def digests(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("canonical_sha256", F.sha2(canonical(F.col(text)), 256))


def known(spark) -> DataFrame:
    """license, canonical_sha256 of this module's licences."""
    whole = [(k, x) for k, found in sorted(DIGESTS.items()) for x in found]
    texts = digests(spark.createDataFrame(sorted(LICENSES.items()), "license string, text string")).select("license", "canonical_sha256")
    return texts.union(spark.createDataFrame(whole, "license string, canonical_sha256 string"))


def scan(docs: DataFrame, registry: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, canonical_sha256, license (null if unknown) of each row.

    registry: license, canonical_sha256, distinct by digest; by default this module's."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256"))
    if registry is None:
        registry = F.broadcast(known(docs.sparkSession).groupBy("canonical_sha256").agg(F.min("license").alias("license")))
    return rows.join(registry, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license")


def line_licenses(spark, text: Column) -> Column:
    """Names of this module's licences and notices that single lines of a text equal, sorted and joined by commas."""
    names = F.create_map(*[F.lit(x) for r in known(spark).groupBy("canonical_sha256").agg(F.min("license").alias("license")).collect() for x in r])
    lines = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), lambda x: x.rlike(WORDS))
    found = F.transform(lines, lambda x: F.try_element_at(names, F.sha2(canonical(x), 256)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",")


def report(docs: DataFrame) -> DataFrame:
    """scan() of entire texts, and beside it the notices that stand on a line of their own."""
    rows = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"), line_licenses(docs.sparkSession, F.col("text")).alias("line_licenses"))
    table = F.broadcast(known(docs.sparkSession).groupBy("canonical_sha256").agg(F.min("license").alias("license")))
    return rows.join(table, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license", "line_licenses")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(column: str) -> str:
        c = f"chr(10) || translate(replace(coalesce({column}, ''), chr(13), chr(10)), '{_UPPER}', '{_LOWER}')"
        c = f"regexp_replace(regexp_replace({c}, {quoted(COPYRIGHT)}, '', 'g'), {quoted(RESERVED)}, '', 'g')"
        c = f"trim(regexp_replace({c}, '{PUNCTUATION}', ' ', 'g'))"
        for a, b in SPELLINGS:
            c = f"replace({c}, '{a}', '{b}')"
        return f"sha256({c})"

    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(_SQL_TEXTS.items()))
    return f"""
with known as (
  select canonical_sha256, min(license) as license
  from (select license, {canon("text")} as canonical_sha256 from (values {values}) as v(license, text)) group by 1),
d as (select doc_id, {canon("text")} as canonical_sha256, text from documents),
lines as (select doc_id, {canon("line")} as canonical_sha256 from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) where regexp_matches(line, '{LINE}')),
noted as (select doc_id, string_agg(distinct license, ',' order by license) as line_licenses from lines join known using (canonical_sha256) group by 1)
select doc_id, d.canonical_sha256, license, coalesce(line_licenses, '') as line_licenses
from d left join known using (canonical_sha256) left join noted using (doc_id)"""


ORACLE = _sql()
