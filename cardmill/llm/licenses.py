"""Licence scan by sentence rules: a text's sentences become identifiers, and ordered rules match runs of identifiers.

A sentence ends at a stop followed by a blank or a line end, and at a blank line; a line of marks only, as in comments, is
blank. It is normalised (A-Z to a-z, every run of other characters than a-z and 0-9 one blank), and the known licence sentences
are looked for in it: one that begins where a line or the sentence does and ends where a line or the sentence does, over as many
lines as it is wrapped to, the longest first. Any other line is unknown. The sequence of identifiers, with one gap sign for any
run of unknown lines, is matched against the rules from left to right; where several rules match, the first in order wins. Only
DataFrame functions; no shuffle.

The SQL knows the same sentences on one line only, and gives the same wherever texts do not wrap licence sentences.

Defined results: a null or empty text, or one without known sentences, has no licences. A known sentence that no rule takes
counts in ``n_sentences`` only. Texts are scanned whole, however long. Rows are scanned one by one. Input columns of the same names as the result's are replaced.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.llm.tables import replace_columns

# fixed values: known licence sentences, normalised, with their identifiers
SENTENCES = {
    "licensed under the apache license version 2 0": "A0",
    "licensed under the apache license version 2 0 the license": "A1",
    "you may not use this file except in compliance with the license": "A2",
    "you may obtain a copy of the license at": "A3",
    "released under the mit license": "M0",
    "this project is licensed under the mit license": "M0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "M1",
    "the software is provided as is without warranty of any kind express or implied": "M2",
    "this work is licensed under the gnu general public license version 3": "G0",
    "this program is free software": "G1",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "G2",
    "this program is distributed in the hope that it will be useful but without any warranty": "G3",
    "licensed under cc by nc 4 0": "C0",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "C0",
    "licensed under cc by 4 0": "D0",
    "this work is licensed under a creative commons attribution 4 0 international license": "D0",
    "redistribution and use in source and binary forms with or without modification are permitted": "B0",
    "redistributions of source code must retain the above copyright notice": "B1",
    "redistributions in binary form must reproduce the above copyright notice": "B2",
    "all rights reserved": "P0",
}
# fixed values: rules in order, an identifier sequence ("--" is one run of unknown sentences) and its licence
RULES = [
    ("A1A2A3", "Apache-2.0"), ("A1A2", "Apache-2.0"), ("A1", "Apache-2.0"), ("A0", "Apache-2.0"), ("A2A3", "Apache-2.0"),
    ("M0M1M2", "MIT"), ("M1--M2", "MIT"), ("M1M2", "MIT"), ("M0", "MIT"), ("M1", "MIT"),
    ("G1G2G3", "GPL-3.0"), ("G1--G2", "GPL-3.0"), ("G1G2", "GPL-3.0"), ("G0", "GPL-3.0"), ("G2", "GPL-3.0"),
    ("C0", "CC-BY-NC-4.0"), ("D0", "CC-BY-4.0"),
    ("B0B1B2", "BSD-2-Clause"), ("B0--B1--B2", "BSD-2-Clause"), ("B0", "BSD-2-Clause"),
    ("P0", "LicenseRef-all-rights-reserved"),
]
# fixed values: whole sentences of the standard texts, normalised, with their identifiers in order
GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
NOTICE = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
FREE = "this program is free software"
CHANGE = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"
LATER = "or at your option any later version"
USEFUL = "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
BINARY_FORMS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
HOLDER = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
APACHE = "licensed under the apache license version 2 0 the license"
EXCEPT = "you may not use this file except in compliance with the license"
WHOLE_SENTENCES = {
    GRANT: "M1", f"{GRANT} {NOTICE}": "M1", NOTICE: "M3", AS_IS: "M2",
    # with the line that wrapped texts end at, where what follows differs
    f"{FREE} {CHANGE} 3 of the license {LATER}": "G2", f"{FREE} {CHANGE} 3 of the license": "G2",
    f"{FREE} {CHANGE} 2 of the license {LATER}": "G4", f"{FREE} {CHANGE} 2 of the license": "G4",
    f"{FREE} you can redistribute it and or modify it under the terms of the gnu general public license": "G1G2",
    f"{USEFUL}": "G3",
    BINARY_FORMS: "B0", f"{BINARY_FORMS} 1": "B0", SOURCE: "B1", f"{BINARY_FORMS} {SOURCE}": "B0B1", BINARY: "B2", HOLDER: "B3",
    f"{SOURCE} {BINARY}": "B1B2", f"{BINARY_FORMS} {SOURCE} {BINARY}": "B0B1B2",
    f"{APACHE} {EXCEPT}": "A1A2", "you may obtain a copy of the license at http www apache org licenses license 2 0": "A3",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "A3",
}
LIBRARY = "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version"
AFFERO = "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"
MOZILLA = "this source code form is subject to the terms of the mozilla public license v"
OBTAIN = "if a copy of the mpl was not distributed with this file you can obtain one at"
ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
WAIVED = "has waived all copyright and related or neighboring rights to this work"
# fixed values: one identifier for each licence that a line can name, and the ends of such lines by licence
NAMED = {
    "M0": ["mit"], "A0": ["apache 2 0"], "I0": ["isc"], "U0": ["unlicense"], "Z0": ["mpl 2 0"], "B5": ["bsd 2 clause"], "B6": ["bsd 3 clause"],
    "G5": ["gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"], "G0": ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"],
    "L1": ["lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"], "L3": ["lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"],
    "V0": ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"], "O0": ["cc0 1 0"], "D0": ["cc by 4 0"], "C0": ["cc by nc 4 0"], "S0": ["cc by sa 4 0"], "N0": ["cc by nc sa 4 0"],
}
MORE_SENTENCES = {
    **{f"spdx license identifier {name}": i for i, names in NAMED.items() for name in names},
    **{f"{how} the {name} license": i for how in ("licensed under", "distributed under", "released under", "this software is licensed under", "this project is released under")
       for i in ("M0", "A0", "I0", "Z0", "B5", "B6") for name in NAMED[i]},
    **{f"licensed under {NAMED[i][0]}": i for i in ("A0", "O0", "S0", "N0")},
    "licensed under the apache license 2 0": "A0", "licensed under the mozilla public license 2 0": "Z0", "licensed under the gnu general public license v3 0": "G0",
    f"{LIBRARY} 2 1 of the license {LATER}": "L1", f"{LIBRARY} 2 1 of the license": "L1", f"{LIBRARY} 3 of the license {LATER}": "L3", f"{LIBRARY} 3 of the license": "L3",
    USEFUL.replace("this program", "this library"): "L2",
    f"{AFFERO} {LATER}": "V0", AFFERO: "V0",
    MOZILLA: "Z0", f"{MOZILLA} 2 0": "Z0", f"{MOZILLA}2 0": "Z0", f"{OBTAIN} http mozilla org mpl 2 0": "Z1", f"{OBTAIN} https mozilla org mpl 2 0": "Z1",
    ISC: "I0", "this is free and unencumbered software released into the public domain": "U0",
    **{f"to the extent possible under law {who} {WAIVED}": "O0" for who in ("the author", "the authors", "the person who associated cc0 with this work")},
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "S0",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "N0",
}
WHOLE_SENTENCES |= MORE_SENTENCES
# fixed values: rules before the others; the list's numbers stand as unknown sentences between its items
WHOLE_RULES = [
    *(("".join(x), "BSD-3-Clause") for x in product(["B0"], ["--", ""], ["B1"], ["--", ""], ["B2"], ["--", ""], ["B3"])),
    *(("".join(x), "BSD-2-Clause") for x in product(["B0"], ["--", ""], ["B1"], ["--", ""], ["B2"])),
    ("M1--M3--M2", "MIT"), ("M1M3M2", "MIT"), ("M1--M3M2", "MIT"), ("M1M3--M2", "MIT"), ("G4G3", "GPL-2.0"), ("G4", "GPL-2.0"),
    ("G5", "GPL-2.0"), ("L1L2", "LGPL-2.1"), ("L1", "LGPL-2.1"), ("L3L2", "LGPL-3.0"), ("L3", "LGPL-3.0"), ("V0G3", "AGPL-3.0"), ("V0", "AGPL-3.0"),
    ("Z0--Z1", "MPL-2.0"), ("Z0Z1", "MPL-2.0"), ("Z0", "MPL-2.0"), ("I0", "ISC"), ("U0", "Unlicense"), ("O0", "CC0-1.0"), ("S0", "CC-BY-SA-4.0"), ("N0", "CC-BY-NC-SA-4.0"),
    ("B5", "BSD-2-Clause"), ("B6", "BSD-3-Clause"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("identifiers", "matches", "n_sentences", "n_matches", "licenses")


def known_lines(text: Column) -> Column:
    """The known sentences and the other lines of a text, in order and normalised."""
    plain = F.translate(F.translate(text, "\x01", " "), UPPER, LOWER)
    plain = F.regexp_replace(plain, r"[.!?](?:[ \t]+|(?=\r?\n))", "\x01")
    plain = F.regexp_replace(plain, "[^a-z0-9\n\x01]+", " ")
    plain = F.regexp_replace(plain, " ?([\n\x01]) ?", "$1")
    plain = F.trim(F.regexp_replace(plain, "\n*\x01[\n\x01]*|\n\n+", "\x01"))
    # the holder that a text names
    plain = F.regexp_replace(plain, r"(?<![^\n\x01])neither[ \n]the[ \n]name[ \n]of(?:[ \n][a-z0-9]+){1,12}?[ \n]nor[ \n]the[ \n]names", "neither the name of the copyright holder nor the names")
    sentences = "|".join(s.replace(" ", "[ \n]") for s in sorted(SENTENCES | WHOLE_SENTENCES, key=len, reverse=True))
    return F.regexp_extract_all(plain, F.lit(f"(?<![^\n\x01])(?:{sentences})(?![^\n\x01])|[^\n\x01]+"), F.lit(0))


def identifier(sentence: Column) -> Column:
    """The identifiers of a normalised sentence, or the gap sign."""
    known = F.create_map(*[F.lit(x) for pair in (SENTENCES | WHOLE_SENTENCES).items() for x in pair])
    return F.coalesce(known[F.translate(sentence, "\n", " ")], F.lit("--"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with identifiers, rule matches in order, their number and the distinct licences."""
    docs = replace_columns(docs, *ADDED)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.array_join(F.transform(known_lines(body), identifier), "")
    found = docs.withColumn("identifiers", F.regexp_replace(row, "(--)+", "--"))
    ordered = WHOLE_RULES + RULES
    rules = F.create_map(*[F.lit(x) for pair in dict(ordered).items() for x in pair])
    found = found.withColumn("matches", F.regexp_extract_all("identifiers", F.lit("|".join(f"({r})" for r, _ in ordered)), F.lit(0)))
    found = found.withColumn("matches", F.transform("matches", lambda m: rules[m]))
    return found.withColumns({
        "n_sentences": F.length(F.regexp_replace("identifiers", "--", "")) / 2,
        "n_matches": F.size("matches").cast("long"),
        "licenses": F.array_join(F.array_sort(F.array_distinct("matches")), ","),
    }).withColumn("n_sentences", F.col("n_sentences").cast("long"))


def oracle(table: str = "documents") -> str:
    """The digest of the query in DuckDB SQL."""
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (SENTENCES | WHOLE_SENTENCES).items()) + "}"
    rules = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in dict(WHOLE_RULES + RULES).items()) + "}"
    pattern = "|".join(f"({r})" for r, _ in WHOLE_RULES + RULES)
    return f"""
WITH a AS (
  SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(13) || chr(10), chr(10)), chr(10)) AS sentences FROM {table}
), b AS (
  SELECT doc_id, list_transform(sentences, lambda x: trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))) AS plain FROM a
), c AS (
  SELECT doc_id, regexp_replace(array_to_string(list_transform(plain, lambda x: CASE WHEN x = '' THEN '' ELSE coalesce({known}[x], '--') END), ''), '(--)+', '--', 'g') AS identifiers FROM b
), d AS (
  SELECT doc_id, identifiers, list_transform(regexp_extract_all(identifiers, '{pattern}'), lambda x: {rules}[x]) AS matches FROM c
)
SELECT doc_id, identifiers, length(replace(identifiers, '--', '')) // 2 AS n_sentences, len(matches) AS n_matches, array_to_string(list_sort(list_distinct(matches)), ',') AS licenses FROM d
"""
