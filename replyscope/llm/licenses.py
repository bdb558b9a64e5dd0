"""Licence recognition by sentence rules, in DataFrame functions only.

A text is normalised to its letters and digits, with borders where a sentence or a unit of its own may begin and end: at line feeds,
behind . ! ? : before white space and behind list marks. A known sentence is found from border to border and may run over
borders inside, so that wrapped lines, comment marks and blank lines before an address do not hide it, while headings and
one-line notices still stand alone. A ; before white space is a border too, but its two sides count only if both are known. Known sentences have identifiers; a text's identifiers in order are its sequence. Rules, in order, name a licence for a run of identifiers; the run they match is taken out of the
sequence, so that a longer rule placed first keeps a shorter one from matching its parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, normalised, by identifier; * stands for one to twelve words.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache-2-licensed": "licensed under the apache license version 2 0",
    "apache-2-the": "licensed under the apache license version 2 0 the license",
    "apache-2-except": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the * nor the names of * may be used to endorse or promote products derived from this software without * prior written permission",
    "bsd-name": "the name of * may not be used to endorse or promote products derived from this software without * prior written permission",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-2-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-redistribute": "this * is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "epl-2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-1": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "artistic-2": "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0",
    "artistic-2-the": "this program is free software you can redistribute it and or modify it under the terms of the the artistic license 2 0",
    "bsl-distributed": "distributed under the boost software license version 1 0",
    "bsl-see": "see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
}
# Ordered rules, licence and run of sentence identifiers.
RULES = (
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT-part", ("mit-grant",)),
    ("Apache-2.0", ("apache-2-the", "apache-2-except", "apache-2-copy", "apache-2-basis")),
    ("Apache-2.0", ("apache-2-the",)),
    ("Apache-2.0", ("apache-2-licensed",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", ("gpl-2-redistribute", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-2-redistribute",)),
    ("GPL-3.0", ("gpl-3-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl-2",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant",)),
    ("LGPL-2.1-or-later", ("lgpl-2-redistribute", "lgpl-warranty")),
    ("LGPL-2.1-or-later", ("lgpl-2-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl-3-redistribute", "lgpl-warranty")),
    ("LGPL-3.0-or-later", ("lgpl-3-redistribute", "gpl-warranty")),
    ("LGPL-3.0-or-later", ("lgpl-3-redistribute",)),
    ("AGPL-3.0-or-later", ("agpl-redistribute", "gpl-warranty")),
    ("AGPL-3.0-or-later", ("agpl-redistribute",)),
    ("EPL-2.0", ("epl-2",)),
    ("EPL-1.0", ("epl-1",)),
    ("Zlib", ("zlib-warranty", "zlib-liable", "zlib-grant")),
    ("Unlicense", ("unlicense-free",)),
    ("Artistic-2.0", ("artistic-2",)),
    ("Artistic-2.0", ("artistic-2-the",)),
    ("BSL-1.0", ("bsl-distributed", "bsl-see")),
    ("BSL-1.0", ("bsl-distributed",)),
    ("BSL-1.0", ("bsl-grant",)),
)
#: Every known sentence holds one of these, so texts without them hold none. No white space: triggers are sought in the text as it is.
TRIGGERS = ("licen", "copyright", "permission", "redistribut", "warrant", "advertis", "liable", "unencumbered")
#: Comment marks made of letters, at the start of a line; other marks are no letters or digits.
COMMENT = r"(^|[\r\n])[ \t]*@?(?:rem|dnl|c)[ \t]"
#: The conjunction of a list whose parts end in ; (at the start of a line, ; is a comment mark).
PART = r"(?<=[^\s;]);\s+(?:and|or)(?=\s)"
#: Borders: line ends, ends of sentences, and list marks such as (a) or 1).
BORDER = r"""[\r\n]+|[.!?:]["')\]]*\s+|(?<!\S)\(?[0-9a-z]{1,2}\)\s"""


def pattern(sentence: str) -> str:
    """Regular expression of a known sentence, with the borders beside it, in a text normalised by ``sequence``."""
    some = "[a-z0-9]+(?:[ |;]+[a-z0-9]+){0,11}?"
    return "([|;])" + "[ |;]+".join(some if w == "*" else w for w in sentence.split()) + "([|;])"


def sequence(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order; of sentences that overlap, the longer one's."""
    # Units stand between signs, "|a b||c;;d|", so that neighbours do not share one.
    norm = F.regexp_replace(F.lower(text), r"[|]|;(?!\s|$)", " ")
    norm = F.regexp_replace(F.regexp_replace(norm, COMMENT, "$1 "), PART, ";")
    norm = F.concat(F.lit("|"), F.regexp_replace(norm, BORDER, "|"), F.lit("|"))
    norm = F.regexp_replace(norm, "[^a-z0-9|;]+", " ")
    norm = F.regexp_replace(F.regexp_replace(norm, r"[ ;]*\|[ |;]*", "||"), " ?;[ ;]*", ";;")
    for ident, s in sorted(sentences.items(), key=lambda x: -len(x[1])):
        norm = F.regexp_replace(norm, pattern(s), f"$1<{ident}>$2")
    known = F.array_join(F.regexp_extract_all(norm, F.lit(r"\|(<[^>|]*>(?:;;<[^>|]*>)*)(?:;;[0-9a-z]{1,2})?\|"), F.lit(1)), "")
    return F.regexp_extract_all(known, F.lit("<([^>]*)>"), F.lit(1))


def license_scan(
    docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES, triggers: tuple[str, ...] = TRIGGERS
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any further columns): doc_id, sentence_ids (known sentences in order), licenses (of
    the matching rules, each once, in rule order) and unmatched (identifiers that no rule took).

    Texts that are null, empty or without a known sentence give empty arrays. A rule that matches several times names
    its licence once. ``triggers`` must hold a part of every known sentence; the scan of other texts ends there. Rows that share an id are
    scanned one by one."""
    nothing = F.array().cast("array<string>")
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = reduce(lambda a, b: a | b, [low.contains(t) for t in triggers])
    ids = docs.select("doc_id", F.when(hit, sequence(F.col("text"), sentences)).otherwise(nothing).alias("sentence_ids"))
    # "|" ends every identifier and stands for a taken run too, so that runs never join over one.
    out = ids.withColumn("rest", F.concat(F.lit("|"), F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")))
    out = out.withColumn("found", nothing)
    for name, run in rules:
        part = "".join(f"<{x}>" for x in run)
        out = out.withColumn("found", F.when(F.col("rest").contains(part), F.concat("found", F.array(F.lit(name)))).otherwise(F.col("found")))
        out = out.withColumn("rest", F.replace("rest", F.lit(part), F.lit("|")))
    rest = F.regexp_extract_all("rest", F.lit("<([^>]*)>"), F.lit(1))
    return out.select("doc_id", "sentence_ids", F.array_distinct("found").alias("licenses"), rest.alias("unmatched"))
