"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from karakuri.llm.decontaminate import op8_decontaminate
from karakuri.llm.html_text import op3_html_text
from karakuri.llm.licenses import TEMPLATES, op6_license_scan
from karakuri.llm.packing import op4_best_fit_packing
from karakuri.llm.pii import op10_pii
from karakuri.llm.ppm import op5_ppm
from karakuri.llm.quality import op1_quality
from karakuri.llm.repeats import op9_repeats
from karakuri.llm.sharding import op2_histogram_shards
from karakuri.llm.simhash import op7_simhash

QUERIES = {"op1_quality": op1_quality, "op2_histogram_shards": op2_histogram_shards, "op3_html_text": op3_html_text, "op4_best_fit_packing": op4_best_fit_packing, "op5_ppm": op5_ppm, "op6_license_scan": op6_license_scan, "op7_simhash": op7_simhash, "op8_decontaminate": op8_decontaminate, "op9_repeats": op9_repeats, "op10_pii": op10_pii}

_REPEATS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 x AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) > 12)),
 m AS (SELECT k, min(doc_id) AS low FROM x GROUP BY k),
 gone AS (SELECT DISTINCT doc_id, s + o AS i FROM x JOIN m USING (k), range(13) t(o) WHERE low < doc_id),
 kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS words, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) p ANTI JOIN gone USING (doc_id, i) GROUP BY p.doc_id)
 SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _licenses() -> str:
    """The scan by exact containment in every window, without MinHash. Template words are cut here as they are there."""
    import re

    rows = []
    for t, (name, text) in enumerate(TEMPLATES):
        words = re.findall(r"[^\W_]+", text.lower())
        k = min(5, len(words))
        reach = max(8, 1 << (len(words) - 1).bit_length())
        shingles = sorted({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})
        rows += [f"({t}, '{name}', {k}, {reach}, {len(shingles)}, '{s}')" for s in shingles]
    return rf"""WITH t(template, license, k, reach, of, s) AS (VALUES {", ".join(rows)}),
 d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
 p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
 x AS (SELECT doc_id, i, k, array_to_string(w[i + 1:i + k], ' ') AS s FROM p, (SELECT DISTINCT k FROM t) WHERE i + k <= len(w)),
 h AS (SELECT doc_id, template, license, reach, of, s, unnest([i // reach - 1, i // reach]) AS b FROM x JOIN t USING (k, s)),
 c AS (SELECT doc_id, license, template, greatest(b, 0) * reach AS first_word, count(DISTINCT s) / of AS share FROM h GROUP BY doc_id, license, template, reach, of, b)
 SELECT doc_id, license, template, round(max(share), 6) AS containment, min(first_word) AS first_word, count(*) AS n_windows FROM c WHERE share >= 0.8 GROUP BY doc_id, license, template"""


#: The other queries rest on XXH64, CRC-32, fitted models or packing, which SQL can't state; tests compare with brute force.
ORACLE_SQL: dict[str, str] = {"op6_license_scan": _licenses(), "op9_repeats": _REPEATS}
