"""License notices in texts, by conditional compression, confirmed by word differences.

A template is found where at most MAX_DIFFERENT of its words differ (inserted, deleted or replaced), and it is exact where none
does. Such a place holds at least one of the template's seeds unchanged: a template in which d words may differ is cut into d + 1
runs of words, and d differences can't reach all of them. Seeds only say where to look, wherever that is in a line or text and
however many notices stand there. Each such stretch is compressed alone and with the template as a raw zstandard dictionary: a
template that saves no byte of it is dropped, and what it saves is compared word by word.

Notices don't overlap. Where they would, the one whose template saves more bytes of its matched words is taken first; saved is
the share of bytes saved. What a taken notice leaves of another's stretch is compressed and compared again.

Cue words are tested on the JVM first, so texts without any never reach Python. Each template has more words with a cue than may
differ, so no text with a notice is without one.

Defined cases
    null or empty text   no notices
    null doc_id          its notices have a null doc_id
    repeated rows        each row's notices are returned
    ties in bytes        the template that agrees in more words, then whose name comes first, then the earlier place
    empty table          no rows
    extra columns        not returned
"""

from __future__ import annotations

import bisect
import functools
import heapq
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import workspace as ws

#: Share of a template's words that may differ.
MAX_DIFFERENT = 0.1

# Words of which a notice has some, and wordings of public notices.
CUES = r"(?i)licen[cs]e|copyright|warrant|distribut|permission|software|gnu|disclaimer|mozilla|waived|neighboring|unencumbered|merchantab|infringe|liab(?:le|ility)|damages|misrepresent"
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": 'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.',
}

_WORD = re.compile(r"\w+(?:[.\-]\w+)*")


def plain_words(text: str) -> list[tuple[str, int, int]]:
    """Lower-case words with their places."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def may_differ(template: list[str]) -> int:
    return int(MAX_DIFFERENT * len(template))


@functools.cache
def _prepared():
    """A plain compressor; name to words and compressor; the shortest seed's length; a seed's first words to (name, place, seed)."""
    options = {"level": 3, "write_content_size": False, "write_checksum": False}
    out, cuts = {}, []
    for name, text in TEMPLATES.items():
        words = [w for w, *_ in plain_words(text)]
        data = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out[name] = words, zstandard.ZstdCompressor(dict_data=data, **options)
        n, runs = len(words), may_differ(words) + 1
        cuts += [(name, n * k // runs, words[n * k // runs : n * (k + 1) // runs]) for k in range(runs)]
    shortest = min(len(seed) for *_, seed in cuts)
    seeds: dict[tuple[str, ...], list[tuple[str, int, list[str]]]] = {}
    for cut in cuts:
        seeds.setdefault(tuple(cut[2][:shortest]), []).append(cut)
    return zstandard.ZstdCompressor(**options), out, shortest, seeds


def differences(block: list[str], template: list[str]) -> tuple[int, int, int]:
    """Fewest words by which some stretch of block differs from template (inserted, deleted or replaced), and that stretch, the
    shortest of those that end first: edit distance with free ends on the side of block, one row for each word of the template."""
    n = len(block)
    cost, begin = [0] * (n + 1), list(range(n + 1))
    for i, word in enumerate(template, 1):
        left, left_begin, diagonal, diagonal_begin = i, 0, cost[0], begin[0]
        cost[0], begin[0] = i, 0
        for j in range(1, n + 1):
            up, up_begin = cost[j], begin[j]
            best, at = diagonal + (word != block[j - 1]), diagonal_begin
            if up + 1 < best or (up + 1 == best and up_begin > at):
                best, at = up + 1, up_begin
            if left + 1 < best or (left + 1 == best and left_begin > at):
                best, at = left + 1, left_begin
            diagonal, diagonal_begin = up, up_begin
            cost[j], begin[j] = left, left_begin = best, at
    end = min(range(n + 1), key=cost.__getitem__)
    return cost[end], begin[end], end


def savings(block: list[str], name: str) -> tuple[int, float]:
    """Bytes of the compressed block that the template saves as a dictionary, and their share of what the block takes alone."""
    alone, templates, *_ = _prepared()
    data = " ".join(block).encode()
    whole = len(alone.compress(data))
    saved = whole - len(templates[name][1].compress(data))
    return saved, saved / whole


def _places(words: list[str]) -> set[tuple[str, int]]:
    """name and the word at which the template would begin (also before the first), for each seed in words."""
    _, _, shortest, seeds = _prepared()
    starts = zip(*(words[k:] for k in range(shortest)))
    return {(name, i - at) for i, first in enumerate(starts) if first in seeds for name, at, seed in seeds[first] if words[i : i + len(seed)] == seed}


def _match(words: list[str], name: str, start: int, low: int, high: int):
    """Best match of the template that begins near start, within words low to high: rank (least first), begin, end, saved, differing
    words; None where the template saves nothing of the stretch, or too many differ."""
    template = _prepared()[1][name][0]
    n, d = len(template), may_differ(template)
    u, v = max(low, start - d), min(high, start + n + d)
    if v - u < n - d or savings(words[u:v], name)[0] <= 0:
        return None
    if low <= start and start + n <= high and words[start : start + n] == template:
        differ, i, j = 0, start, start + n
    else:
        differ, i, j = differences(words[u:v], template)
        i, j = u + i, u + j
        if differ > d:
            return None
    saved, share = savings(words[i:j], name)
    return (-saved, 2 * differ - n, name, i), i, j, share, differ


def scan(text: str) -> list[tuple[str, int, int, float, int, bool]]:
    """license, begin, end (characters), share saved, differing words, exact."""
    whole = plain_words(text)
    words = [w for w, *_ in whole]
    heap = [(*m, start) for name, start in _places(words) if (m := _match(words, name, start, 0, len(words)))]
    heapq.heapify(heap)
    taken: list[tuple[int, int, str, float, int]] = []
    while heap:
        (*_, name, _), i, j, saved, differ, start = heapq.heappop(heap)
        k = bisect.bisect_left(taken, (i,))
        if not (k and taken[k - 1][1] > i) and not (k < len(taken) and taken[k][0] < j):
            taken.insert(k, (i, j, name, saved, differ))
            continue
        # the free stretches that the match reaches into
        d = may_differ(_prepared()[1][name][0])
        low, high = start - d, start + len(_prepared()[1][name][0]) + d
        k = max(0, bisect.bisect_left(taken, (low,)) - 1)
        free, at = [], low
        while k < len(taken) and taken[k][0] < high:
            free.append((at, taken[k][0]))
            at = max(at, taken[k][1])
            k += 1
        for u, v in (*free, (at, high)):
            if u < v and (m := _match(words, name, start, max(0, u), min(len(words), v))):
                heapq.heappush(heap, (*m, start))
    return [(name, whole[i][1], whole[j - 1][2], saved, differ, differ == 0) for i, j, name, saved, differ in taken]


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, license, begin, end, saved, n_differ, exact of every notice in docs."""
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.bool_())
    names = ["doc_id", "license", "begin", "end", "saved", "n_differ", "exact"]

    def run(batches):
        for batch in batches:
            rows = [(doc_id, *hit) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in scan(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    cued = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(CUES))
    return cued.mapInArrow(run, "doc_id bigint, license string, begin int, end int, saved double, n_differ int, exact boolean")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice of every document."""
    return find_licenses(ws.table(spark, sf_dir, "documents"))
