"""SQL for the rows of the queries, written from the operators' definitions."""

from __future__ import annotations

from octetflow.functions.digests import OFFSET, PRIME
from octetflow.operators.chunking import GEAR
from octetflow.plans.queries import BLOCK, K, KEY, LEVELS, N

_PATH = "coalesce(lang, '') || '/' || doc_id || '.txt'"
_F = f"f AS (SELECT doc_id, folder, folder || '/' || {_PATH} AS relative_path, text, strlen(text)::BIGINT AS size FROM (SELECT doc_id, lang, coalesce(source, '') AS folder, coalesce(text, '') AS text FROM documents))"
_S = f"""s AS (SELECT doc_id, folder, folder || '/' || {_PATH} AS relative_path, text, strlen(text)::BIGINT AS size
FROM (SELECT doc_id, lang, CASE WHEN source = 'src1' THEN 'src1-moved' ELSE coalesce(source, '') END AS folder, replace(coalesce(text, ''), '@', ' (at) ') AS text FROM documents))"""


def _bytes(text: str, kind: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::{kind})"


def _fold(items: str) -> str:
    return f"list_reduce({items}, lambda h, b: xor(h, b) * {PRIME} % 18446744073709551616, {OFFSET}::UHUGEINT)"


def _pad(mask: int) -> str:
    """The key under a mask, as HMAC puts it before its text: a key of 32 bytes fills half a block of SHA-256."""
    return f"unhex('{bytes(k ^ mask for k in KEY.ljust(64, bytes(1))).hex()}')"


def _hex16(value: str) -> str:
    return f"lpad(lower(hex(({value})::UBIGINT)), 16, '0')"


def _fnv(text: str) -> str:
    return _hex16(_fold(_bytes(text, "UHUGEINT")))


_CRC_TABLE = "crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i))"
_CRC = f"hex(xor(list_reduce({_bytes('text', 'BIGINT')}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT))"
_LIST_F = f"lf AS (SELECT folder, relative_path, {_fnv('text')} AS hash, size FROM f)"
_LIST_S = f"ls AS (SELECT folder, relative_path, {_fnv('text')} AS hash, size FROM s)"


def _digest(name: str, of: str) -> str:
    lines = "string_agg(relative_path || ':' || hash || ':' || size || ';', '' ORDER BY encode(relative_path))"
    return f"{name} AS (SELECT folder, {_fnv('lines')} AS folder_hash, files, bytes FROM (SELECT folder, {lines} AS lines, count(*) AS files, sum(size)::BIGINT AS bytes FROM {of} GROUP BY folder))"


_COMPARED = """cmp AS (SELECT coalesce(lf.folder, ls.folder) AS folder, coalesce(lf.relative_path, ls.relative_path) AS relative_path,
CASE WHEN ls.relative_path IS NULL THEN 'only_in_first' WHEN lf.relative_path IS NULL THEN 'only_in_second' WHEN lf.hash = ls.hash AND lf.size = ls.size THEN 'identical' ELSE 'modified' END AS status
FROM lf FULL OUTER JOIN ls ON lf.folder = ls.folder AND lf.relative_path = ls.relative_path)"""


def _cuts(name: str, of: str) -> str:
    """Chunks of ``of``: bits of the rolling hash from the last nine bytes, then one cut after another."""
    words = "[" + ", ".join(str(int(x) & 511) for x in GEAR) + "]"
    parts = "(g & 511)"
    for k in range(1, 9):
        parts = f"xor({parts}, (lag(g, {k}, 0) OVER w << {k}) & 511)"
    rule = "(h & CASE WHEN i - (pos + len) < 512 THEN 511 WHEN i - (pos + len) <= 768 THEN 255 ELSE 127 END) = 0"
    rule = rule.replace("(h &", "(s.h &").replace("i - (", "s.i - (")
    return f"""{name}_g AS (SELECT doc_id, unnest(list_transform({_bytes('text', 'INTEGER')}, lambda x: {words}[x + 1])) AS g, generate_subscripts({_bytes('text', 'INTEGER')}, 1) AS i FROM {of}),
{name}_h AS (SELECT doc_id, i, {parts} AS h FROM {name}_g WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{name}_d AS MATERIALIZED (SELECT doc_id, text, size AS n, coalesce(stops, []) AS stops FROM {of} LEFT JOIN (SELECT doc_id, list({{'i': i, 'h': h}} ORDER BY i) AS stops FROM {name}_h WHERE h & 127 = 0 GROUP BY doc_id) USING (doc_id)),
{name}_c AS (SELECT doc_id, 0::BIGINT AS pos, 0::BIGINT AS len, 0 AS level FROM {name}_d UNION ALL
SELECT doc_id, p, coalesce(k, least(1024, n - p)), CASE WHEN k IS NULL AND n - p < 1024 THEN 2 ELSE 0 END FROM (SELECT doc_id, pos + len AS p, n,
list_min(list_transform(list_filter(stops, lambda s: s.i - (pos + len) BETWEEN 256 AND 1023 AND {rule}), lambda s: s.i - (pos + len))) AS k FROM {name}_c JOIN {name}_d USING (doc_id) WHERE pos + len < n)),
{name}_p AS MATERIALIZED (SELECT doc_id, pos, len, level, substr(hex(encode(text)), (2 * pos + 1)::BIGINT, 2 * len) AS part FROM {name}_c JOIN {name}_d USING (doc_id) WHERE len > 0)"""


_WORD = "('0x' || " + " || ".join(f"substr(x, {k}, 2)" for k in range(15, 0, -2)) + ")::UHUGEINT"


def _hashed(name: str) -> str:
    tail = "list_transform(regexp_extract_all(substr(part, 16 * (len // 8) + 1), '..'), lambda x: ('0x' || x)::UHUGEINT)"
    state = _fold(f"list_concat(list_transform(regexp_extract_all(part, '.{{16}}'), lambda x: {_WORD}), {tail})")
    return f"{name}_x AS MATERIALIZED (SELECT doc_id, pos, len, level, part, {_hex16('xor(h, h >> 32)')} AS hash FROM (SELECT *, {state} AS h FROM {name}_p))"


_OPS = f"""WITH RECURSIVE {_F}, {_S}, {_cuts('a', 'f')}, {_hashed('a')}, {_cuts('b', 's')}, {_hashed('b')},
idx AS (SELECT doc_id, hash, max(pos) AS src_pos, arg_max(part, pos) AS part FROM a_x GROUP BY doc_id, hash),
placed AS (SELECT doc_id, pos, len, src_pos FROM b_x JOIN idx USING (doc_id, hash) WHERE substr(idx.part, 1, 2 * len) = b_x.part UNION ALL SELECT doc_id, size, 0, NULL FROM s),
gaps AS (SELECT *, coalesce(lag(pos + len) OVER (PARTITION BY doc_id ORDER BY pos, src_pos IS NULL), 0) AS since FROM placed),
ops AS (SELECT doc_id, 'INSERT' AS op, NULL::BIGINT AS src_pos, since AS dst_pos, pos - since AS len FROM gaps WHERE pos > since
UNION ALL SELECT doc_id, 'COPY', src_pos, pos, len FROM gaps WHERE src_pos IS NOT NULL),
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY dst_pos) - 1 AS seq, op, src_pos, dst_pos, len FROM ops)
"""

_NOT_EMPTY = f"FROM f, (SELECT unnest({LEVELS}) AS level) WHERE size > 0"
_FORMAT = "CASE WHEN level <= 6 THEN 'LZ4 Frame' WHEN level <= 15 THEN 'ZSTD' ELSE 'LZMA2/XZ' END"
_SHA = "sha256(text)"
_NAME = "regexp_extract(relative_path, '[^/]*$')"
_ENTRY = "12 + strlen(relative_path) + size"
_PARTS = "string_split(relative_path, '/')"


def _little(value: str, width: int) -> str:
    digits = f"lpad(hex({value}), {2 * width}, '0')"
    return " || ".join(f"substr({digits}, {k}, 2)" for k in range(2 * width - 1, 0, -2))


ORACLES: dict[str, str] = {
    "file_digests": f"WITH {_F}, {_CRC_TABLE} SELECT doc_id, relative_path, size, {_SHA} AS sha256, {_CRC} AS crc32, {_fnv('text')} AS fnv FROM f, crc",
    "hash_sha256": f"WITH {_F} SELECT doc_id, {_SHA} AS sha256 FROM f",
    "hash_crc32": f"WITH {_F}, {_CRC_TABLE} SELECT doc_id, {_CRC} AS crc32 FROM f, crc",
    "hash_fnv1a": f"WITH {_F} SELECT doc_id, {_fnv('text')} AS fnv FROM f",
    "folder_listing": f"WITH {_F}, {_LIST_F} SELECT folder, relative_path, hash, size FROM lf",
    "folder_digest": f"WITH {_F}, {_LIST_F}, {_digest('d', 'lf')} SELECT * FROM d",
    "folder_compare": f"WITH {_F}, {_S}, {_LIST_F}, {_LIST_S}, {_COMPARED} SELECT relative_path, status FROM cmp",
    "folder_summary": f"""WITH {_F}, {_S}, {_LIST_F}, {_LIST_S}, {_COMPARED} SELECT folder, count(*) FILTER (status = 'only_in_first') AS only_in_first, count(*) FILTER (status = 'only_in_second') AS only_in_second,
count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'identical') AS identical, bool_and(status = 'identical') AS are_identical FROM cmp GROUP BY folder""",
    "folder_only_left": f"WITH {_F}, {_S} SELECT relative_path FROM f WHERE relative_path NOT IN (SELECT relative_path FROM s)",
    "folder_only_right": f"WITH {_F}, {_S} SELECT relative_path FROM s WHERE relative_path NOT IN (SELECT relative_path FROM f)",
    "folder_common": f"WITH {_F}, {_S} SELECT relative_path FROM f JOIN (SELECT DISTINCT relative_path FROM s) USING (relative_path)",
    "folder_identical": f"""WITH {_F}, {_S}, {_LIST_F}, {_LIST_S}, {_digest('d', 'lf')}, {_digest('e', 'ls')}
SELECT coalesce(d.folder, e.folder) AS folder, coalesce(d.folder_hash = e.folder_hash, FALSE) AS are_identical FROM d FULL OUTER JOIN e ON d.folder = e.folder""",
    "folder_report": f"""WITH {_F}, lf AS (SELECT '' AS folder, relative_path, {_fnv('text')} AS hash, size FROM f), {_digest('d', 'lf')}
SELECT unnest(['Folder: documents', 'Hash: ' || folder_hash, 'Total Files: ' || files, '']) AS value FROM d UNION ALL SELECT unnest([relative_path, '  Hash: ' || hash, '  Size: ' || size || ' bytes', '']) FROM lf""",
    "path_names": f"""SELECT page_id, relative_path, {_NAME} AS name, regexp_replace({_NAME}, '\\.[^.]*$', '') AS stem, '.html' AS extension, relative_path <> '' AND NOT ends_with(relative_path, '/') AS kept
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || '.v1.html' AS relative_path FROM pages)""",
    "metadata_json": f"WITH {_F} SELECT doc_id, {_NAME} AS original_filename, 8 * size AS binary_length, length(bin(8 * size)) AS bits FROM f",
    "archive_layout": f"""WITH {_F} SELECT folder, row_number() OVER w - 1 AS idx, relative_path, (4 + coalesce(sum({_ENTRY}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset, size AS data_size
FROM f WINDOW w AS (PARTITION BY folder ORDER BY {_PARTS})""",
    "archive_pieces": f"""WITH {_F} SELECT folder, 0::BIGINT AS offset, 4::BIGINT AS bytes, sha256(from_hex({_little('count(*)', 4)})) AS sha256 FROM f GROUP BY folder UNION ALL
SELECT folder, (4 + coalesce(sum({_ENTRY}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT, {_ENTRY},
sha256(from_hex({_little('strlen(relative_path)', 4)} || hex(encode(relative_path)) || {_little('size', 8)} || hex(encode(text)))) FROM f WINDOW w AS (PARTITION BY folder ORDER BY {_PARTS})""",
    "pack_roundtrip": f"WITH {_F} SELECT relative_path, size, {_SHA} AS sha256 FROM f",
    "zip_roundtrip": f"WITH {_F} SELECT relative_path, size, {_SHA} AS sha256 FROM f",
    "format_detect": f"WITH {_F} SELECT doc_id, level, {_FORMAT} AS format, TRUE AS is_compressed {_NOT_EMPTY}",
    "compress_roundtrip": f"WITH {_F} SELECT doc_id, level, {_SHA} AS sha256 {_NOT_EMPTY}",
    "chunk_cuts": f"WITH RECURSIVE {_F}, {_cuts('a', 'f')} SELECT doc_id, pos, len, level FROM a_p",
    "chunk_dedup": f"WITH RECURSIVE {_F}, {_cuts('a', 'f')}, {_hashed('a')} SELECT hash, max(pos) AS last_pos, count(*) AS copies FROM a_x GROUP BY hash",
    "diff_ops": _OPS + "SELECT doc_id, seq, op, src_pos, dst_pos, len FROM numbered",
    "patch_size": _OPS + "SELECT doc_id, 9 + coalesce(sum(CASE WHEN op = 'COPY' THEN 13 ELSE 5 + len END), 0)::BIGINT AS patch_bytes FROM s LEFT JOIN numbered USING (doc_id) GROUP BY doc_id",
    "patch_roundtrip": f"WITH {_S} SELECT doc_id, {_SHA} AS sha256 FROM s",
    "patch_commands": _OPS + """SELECT doc_id, seq, op, src_pos, dst_pos, len, CASE WHEN op = 'INSERT' THEN sha256(from_hex(substr(hex(encode(text)), (2 * dst_pos + 1)::BIGINT, 2 * len))) END AS payload_sha256
FROM numbered JOIN (SELECT doc_id, text FROM s) USING (doc_id)""",
    "bmp_geometry": f"""WITH {_F}, g AS (SELECT doc_id, grey, ceil(sqrt(CASE WHEN grey THEN size ELSE 8 * size END))::BIGINT AS width FROM f, (SELECT unnest([FALSE, TRUE]) AS grey)),
h AS (SELECT *, CASE WHEN grey THEN (width + 3) // 4 * 4 ELSE (width + 31) // 32 * 4 END AS stride FROM g) SELECT doc_id, grey, width, stride, stride * width AS pixel_bytes FROM h""",
    # 14 bytes, 11 and its name for each of the eight fields, and the values' bits: length, name, three flags, version, no XXH3, SHA-256
    "header_size": f"""WITH {_F} SELECT doc_id, 14 + 8 * 11 + strlen('binary_length' || 'filename' || 'encrypted' || 'v' || 'compress' || 'pack' || 'hash' || 'SHA')
+ (greatest(1, length(bin(8 * size))) + 8 * strlen({_NAME}) + 3 + 24 + 512 + 7) // 8 AS header_bytes FROM f""",
    "hash_hmac": f"WITH {_F} SELECT doc_id, sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(text)))) AS hmac FROM f",
    "name_numbers": """SELECT doc_id, coalesce(source, '') AS folder_name, TRY_CAST(substr(source, 4) AS BIGINT) AS number, NULL::BIGINT AS no_number, -doc_id AS negative,
        round(size::DOUBLE / n_chars, 9) AS ratio, round(100 * (1 - n_chars::DOUBLE / size), 9) AS reduction, round(100 * (size::DOUBLE / n_chars - 1), 9) AS expansion
        FROM (SELECT *, strlen(coalesce(text, '')) AS size FROM documents)""",
    "encode_roundtrip": f"WITH {_F} SELECT doc_id, {_NAME} AS filename, {_SHA} AS sha256, TRUE AS hash_ok, TRUE AS sha_ok, TRUE AS crc_ok, TRUE AS verified, TRUE AS compressed FROM f",
    "decode_damaged": f"WITH {_F} SELECT doc_id, FALSE AS hash_ok, FALSE AS sha_ok, FALSE AS crc_ok, FALSE AS verified FROM f WHERE size > 0",
    "block_fnv": f"WITH {_F} SELECT relative_path, {_fnv('text')} AS fnv, greatest(1, (size + {BLOCK - 1}) // {BLOCK}) AS blocks, size FROM f",
    "block_shares": f"WITH {_F} SELECT relative_path, share_id, (size + {K - 1}) // {K} AS payload_bytes FROM f, range(1, {N + 1}) r(share_id)",
    "gf256_table": """SELECT a, b, list_reduce(range(7, -1, -1), lambda r, k: xor(CASE WHEN r >= 128 THEN xor(2 * r, 285) ELSE 2 * r END, CASE WHEN (b >> k) & 1 = 1 THEN a ELSE 0 END), 0::BIGINT) AS product
FROM range(256) x(a), range(256) y(b)""",
    "share_sizes": f"""WITH {_F} SELECT doc_id, share_id, (size + {K - 1}) // {K} AS payload_bytes, (size + {K - 1}) // {K} + 101 AS share_bytes, {N} / {K}::DOUBLE AS storage_ratio, {N - K}::BIGINT AS redundancy
FROM f, range(1, {N + 1}) r(share_id)""",
    "integrate_roundtrip": f"WITH {_F} SELECT relative_path, {_SHA} AS sha256 FROM f",
    "shares_agree": f"WITH {_F} SELECT relative_path, TRUE AS agree FROM f",
}
