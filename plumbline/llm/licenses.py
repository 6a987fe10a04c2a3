"""License notices by MinHash bands over overlapping text windows, verified by exact containment.

Words are compared in lower case, with ASCII punctuation as white space. A template of k five-word
shingles is looked for in windows of k + step shingles, which begin every step = max(1, k // 4)
shingles, so that every place where the template can stand lies whole in some window. A window
retrieves a template when one of BANDS least hashes is equal. At a containment of 0.8 window and
template have a Jaccard similarity of 0.8 / 1.45 = 0.55 at least (0.67 for step 1 without overhang),
so a band of one row collides with that probability and BANDS = 24 of them miss a match once in
2e8 (0.45 ** 24). What is retrieved is verified by its words themselves: the share of the template's
distinct shingles that the window holds, 0.8 or more.

A window that holds none of the shingles behind the templates' least hashes can't retrieve; the others'
least hashes come from one table of minima over 1, 2, 4, ... shingles, so overlap
costs nothing; a long text is worked through a span of words at a time. Templates are a bounded parameter (MAX_TEMPLATES) and are sent to every task; texts
are not shuffled.

Null and empty texts match nothing; a text of fewer than five words has no shingles. A null id is
carried as it is, each row is judged alone. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textwords as T

U = np.uint64
SHINGLE, BANDS, CONTAINMENT, MAX_TEMPLATES = 5, 24, 0.8, 5000
_NEVER = U(2**64 - 1)
_SEEDS = T.mix(np.arange(101, 101 + BANDS, dtype=U) * U(0xD1B54A32D192ED03))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FOLD[[ord(c) for c in PUNCTUATION]] = 0x20

#: Notices of common licenses, and the texts of those that are short enough to stand whole in a document.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def folded(texts: pa.Array) -> pa.Array:
    """Texts in lower case, with ASCII punctuation as spaces; of the same bytes otherwise."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    valid, offsets, data = texts.buffers()
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(_FOLD[np.frombuffer(data, np.uint8)].tobytes()) if data is not None else data], offset=texts.offset)


def _shingles(w: T.Words, lo: int, hi: int) -> set[tuple[bytes, ...]]:
    words = [bytes(w.data[a:z]) for a, z in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist())]
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


class Templates:
    def __init__(self, texts: dict[str, str]) -> None:
        if len(texts) > MAX_TEMPLATES:
            raise ValueError(f"{MAX_TEMPLATES} templates at most")
        self.names = sorted(texts)
        w = T.of(folded(pa.array([texts[n] for n in self.names], pa.string())))
        h, ok = w.windows(SHINGLE)
        self.sets = [np.unique(h[a:b][ok[a:b]]) for a, b in zip(w.first, w.first[1:])]
        short = [n for n, s in zip(self.names, self.sets) if not len(s)]
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        # words of a template, repeated shingles included, set its window
        self.span = np.maximum(w.n_words - SHINGLE + 1, 1)
        least = np.array([[T.mix(s ^ x).min() for s in self.sets] for x in _SEEDS], U).reshape(BANDS, -1)
        # the shingles that have these least hashes: a window without one of them retrieves nothing
        self.keys = np.unique([s[T.mix(s ^ x).argmin()] for s in self.sets for x in _SEEDS]) if self.sets else np.zeros(0, U)
        self.classes = {}
        for k in np.unique(self.span).tolist():
            own = np.flatnonzero(self.span == k)
            self.classes[k] = (own, least[:, own])
        self.words = [_shingles(w, a, b) for a, b in zip(w.first.tolist(), w.first[1:].tolist())]
        self.longest = max((k + max(1, k // 4) for k in self.classes), default=1)


def _matches(w: T.Words, t: Templates, containment: float) -> list[tuple[int, int, int, int]]:
    """(text, template, first word of its best window, shingles shared) of all matches."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    n_words = len(w.start)
    logs = np.floor(np.log2(np.maximum(np.arange(t.longest + 1), 1))).astype(np.int64)
    for lo, hi in w.spans():
        # windows that begin in this span, and all that they reach
        h, ok = w.windows(SHINGLE, lo, min(n_words, hi + t.longest))
        hit = ok & np.isin(h, t.keys)
        if not hit.any():
            continue
        before = np.concatenate(([0], np.cumsum(hit)))
        text = w.text_of(lo, hi)
        place = np.arange(lo, hi) - w.first[text]
        starts, sizes, need = {}, {}, np.zeros(len(h) + 1, np.int32)
        for k in t.classes:
            i = np.flatnonzero(ok[: hi - lo] & (place % max(1, k // 4) == 0))
            n = np.minimum(_reach(k), w.first[text[i] + 1] - lo - i)
            some = before[i + n] > before[i]
            starts[k], sizes[k] = i[some], n[some]
            np.add.at(need, i[some], 1)
            np.add.at(need, i[some] + n[some], -1)
        # the windows that are left, side by side; each stays in one piece
        used = np.cumsum(need[:-1]) > 0
        at = np.cumsum(used) - 1
        line = np.where(ok, h, _NEVER)
        short, there = line[used], ok[used]
        found: set[tuple[int, int]] = set()
        for band in range(BANDS if len(short) else 0):
            level = [np.where(there, T.mix(short ^ _SEEDS[band]), _NEVER)]
            while 2 ** len(level) <= t.longest:
                x, s = level[-1], 2 ** (len(level) - 1)
                y = x.copy()
                np.minimum(x[:-s], x[s:], out=y[:-s])
                level.append(y)
            for k, (own, least) in t.classes.items():
                i, n = at[starts[k]], sizes[k]
                low = np.full(len(i), _NEVER)
                j = logs[n]
                for v in np.unique(j).tolist():
                    o = np.flatnonzero(j == v)
                    low[o] = np.minimum(level[v][i[o]], level[v][i[o] + n[o] - 2**v])
                hit = np.flatnonzero(np.isin(low, least[band]))
                for p in hit.tolist():
                    for c in np.flatnonzero(least[band] == low[p]).tolist():
                        found.add((int(starts[k][p]), int(own[c])))
        for p, c in sorted(found):
            stop = min(p + _reach(int(t.span[c])), int(w.first[text[p] + 1]) - lo)
            part = line[p:stop][ok[p:stop]]
            need = round(containment * 1_000_000) * len(t.words[c])
            if len(np.intersect1d(part, t.sets[c])) * 1_000_000 < need:
                continue
            shared = len(_shingles(w, lo + p, min(lo + stop + SHINGLE - 1, int(w.first[text[p] + 1]))) & t.words[c])
            if shared * 1_000_000 >= need:
                key = (int(text[p]), c)
                if key not in best or shared > best[key][1]:
                    best[key] = (int(place[p]), shared)
    return [(d, c, p, s) for (d, c), (p, s) in sorted(best.items())]


def _reach(k: int) -> int:
    """Shingles of a window for templates of k shingles."""
    return k + (max(1, k // 4) if k >= 4 else 0)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, first_word, n_shared, n_template, containment): a row for each document and
    template that some window of it contains, with the window that shares most (the first of those)."""
    common.tune(docs.sparkSession)
    texts = TEMPLATES if templates is None else templates
    Templates(texts)  # bad ones fail here
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int64()), ("n_shared", pa.int64()), ("n_template", pa.int64()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(texts)
        for b in batches:
            text = T.column(b, "text")
            ids = T.column(b, "doc_id")
            for s, e in T.chunks(text, 2 << 20):
                rows = _matches(T.of(folded(text.slice(s, e - s))), t, containment) if t.names else []
                if rows:
                    d, c, p, n = (np.array(x) for x in zip(*rows))
                    k = np.array([len(x) for x in t.words])[c]
                    yield pa.RecordBatch.from_arrays([ids.slice(s, e - s).take(pa.array(d)), pa.array([t.names[x] for x in c]), pa.array(p), pa.array(n), pa.array(k), pa.array(n / k)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, license string, first_word long, n_shared long, n_template long, containment double")


def sql() -> str:
    """The same in DuckDB's SQL, without MinHash: every window's shingles against every template's."""
    rows = ", ".join("('{}', '{}')".format(n, x.replace("'", "''")) for n, x in TEMPLATES.items())
    marks = PUNCTUATION.replace("'", "''")
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(license, text)),
raw AS (SELECT 0 AS is_t, doc_id, '' AS license, text FROM documents UNION ALL SELECT 1, NULL, license, text FROM t),
cut AS (SELECT is_t, doc_id, license, list_filter(regexp_split_to_array(translate(lower(text), '{marks}', repeat(' ', {len(PUNCTUATION)})), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM raw),
sh AS (SELECT is_t, doc_id, license, unnest(range(0, greatest(len(w) - 4, 0)::BIGINT)) AS i, w FROM cut),
s AS (SELECT is_t, doc_id, license, i, array_to_string(w[i + 1 : i + 5], ' ') AS g, len(w) - 4 AS k FROM sh),
ts AS (SELECT DISTINCT license, g, k FROM s WHERE is_t = 1),
tk AS (SELECT license, any_value(k) AS k, count(*) AS n_template FROM ts GROUP BY license),
hit AS (SELECT s.doc_id, ts.license, s.i, s.g, tk.k, tk.n_template, greatest(1, tk.k // 4) AS step, tk.k + CASE WHEN tk.k >= 4 THEN greatest(1, tk.k // 4) ELSE 0 END AS n
        FROM s JOIN ts ON s.g = ts.g JOIN tk ON tk.license = ts.license WHERE s.is_t = 0),
win AS (SELECT doc_id, license, n_template, g, unnest(range((greatest(0, i - n + 1) + step - 1) // step * step, i + 1, step)) AS p FROM hit),
per AS (SELECT doc_id, license, p, n_template, count(DISTINCT g) AS n_shared FROM win GROUP BY ALL),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY n_shared DESC, p) AS r FROM per WHERE n_shared * 1000000 >= 800000 * n_template)
SELECT doc_id, license, p::BIGINT AS first_word, n_shared::BIGINT AS n_shared, n_template::BIGINT AS n_template, n_shared::DOUBLE / n_template AS containment FROM ok WHERE r = 1"""
