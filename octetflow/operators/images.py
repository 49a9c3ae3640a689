"""Files into self-describing bitmaps and back, with their checks, as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetflow.functions import container as C
from octetflow.functions.chacha import batch_cipher_many
from octetflow.functions.codecs import compress, decompress
from octetflow.functions.digests import key_bytes
from octetflow.operators.archive import unpack_entries

_STATUS = pa.struct([("filename", pa.string()), ("content", pa.binary()), ("hash_ok", pa.bool_()), ("sha_ok", pa.bool_()), ("crc_ok", pa.bool_()), ("verified", pa.bool_()), ("accepted", pa.bool_()), ("compressed", pa.bool_()), ("packed", pa.bool_()), ("error", pa.string())])
STATUS = "struct<filename:string,content:binary,hash_ok:boolean,sha_ok:boolean,crc_ok:boolean,verified:boolean,accepted:boolean,compressed:boolean,packed:boolean,error:string>"


def encode(
    files: DataFrame, name: str = "path", content: str = "content", level: int | None = None, key: str | bytes | None = None, grey: bool = False, packed: bool = False,
    with_hash: bool = True, sha: bool = False, crc: bool = False, two_file: bool = False,
) -> DataFrame:
    """``files`` with a column ``image``, and with ``two_file`` another, ``metadata``, a map of strings for a file beside the image, which then holds no header.

    ``level`` compresses first; ``key`` (32 bytes, of a password; other lengths are folded) encrypts; digests are of what is stored. The key is an option, never a column:
    whoever writes ``metadata`` must keep the key elsewhere."""

    def run(names, data):
        out = []
        stored = [compress(d, level) if level and d else d for d in data.to_pylist()]
        secret = batch_cipher_many(key_bytes(key), stored) if key is not None else stored
        for n, d, body in zip(names.to_pylist(), stored, secret, strict=True):
            head = C.header_for(d, n.rsplit("/", 1)[-1], key is not None, bool(level), packed, with_hash=with_hash, sha=sha, crc=crc)
            fields = C.HeaderReader(head.to_bytes()).as_strings()
            apart = {"original_filename": fields.pop("filename"), **fields} if two_file else {}
            apart.pop("encrypted", None)
            out.append({"image": C.bmp_encode(body, b"" if two_file else head.to_bytes(), grey=grey), "metadata": list(apart.items())})
        return pa.array(out, pa.struct([("image", pa.binary()), ("metadata", pa.map_(pa.string(), pa.string()))]))

    made = files.withColumn("made", F.arrow_udf(run, "struct<image:binary,metadata:map<string,string>>")(F.col(name), F.col(content)))
    return made.withColumn("image", F.col("made.image")).withColumns({"metadata": F.col("made.metadata")} if two_file else {}).drop("made")


def _payload(raw: bytes, beside, key, errors) -> tuple[dict, bytes, bool, str | None]:
    """(fields, stored payload, whether to decipher it, error)"""
    try:
        head = C.bmp_header(raw)
        if head is not None:
            fields, secret = head.as_strings(), head.boolean("encrypted")
        elif beside is not None:
            fields, secret = dict(beside), key is not None
            fields["filename"] = fields["original_filename"]
        else:
            raise ValueError("the image holds no header")
        if secret and key is None:
            raise ValueError("the payload is encrypted and no key is given")
        return fields, C.bmp_decode(raw, int(fields["binary_length"]) // 8), bool(secret and key is not None), None
    except errors as e:
        return {}, b"", False, str(e) or type(e).__name__


def decode(images: DataFrame, image: str = "image", key: str | bytes | None = None, metadata: str | None = None) -> DataFrame:
    """``images`` with filename, content (decompressed where it was compressed), hash_ok, sha_ok, crc_ok (null: not stored), verified (all stored digests agree; null where none is stored, as
    nothing then tells a wrong key), accepted (what stored images pass by: true also where no XXH3 is stored), compressed, packed and error. A damaged
    image, or an encrypted one without a key, gives an error in its row and fails nothing else. ``metadata``: a column with the map of images without a header."""

    def run(data, apart):
        out, errors = [], (ValueError, KeyError, OSError, EOFError)
        found = [_payload(raw, beside, key, errors) for raw, beside in zip(data.to_pylist(), apart.to_pylist(), strict=True)]
        hidden = [k for k, (_, _, secret, _) in enumerate(found) if secret]
        plain = dict(zip(hidden, batch_cipher_many(key_bytes(key), [found[k][1] for k in hidden]) if hidden else [], strict=True))
        for k, (fields, body, _, error) in enumerate(found):
            row = dict.fromkeys(x.name for x in _STATUS)
            try:
                if error:
                    raise ValueError(error)
                body = plain.get(k, body)
                seen = C.verify(body, {k: fields.get(k, "") for k in ("hash", "SHA", "CRC")})
                known = [seen[x] for x in ("hash", "SHA", "CRC") if seen[x] is not None]
                row |= {"filename": fields["filename"], "hash_ok": seen["hash"], "sha_ok": seen["SHA"], "crc_ok": seen["CRC"], "verified": all(known) if known else None, "accepted": seen["overall"], "compressed": fields.get("compress") == "true", "packed": fields.get("pack") == "true"}
                row["content"] = decompress(body) if row["compressed"] and body else body
            except errors as e:
                row |= {"error": str(e), "verified": False, "accepted": False}
            out.append(row)
        return pa.array(out, _STATUS)

    rest = [c for c in images.columns if c != image and c not in {x.name for x in _STATUS}]
    beside = F.col(metadata) if metadata else F.lit(None).cast("map<string,string>")
    return images.select(*rest, F.arrow_udf(run, STATUS)(F.col(image), beside).alias("d")).select(*rest, "d.*")


def header_fields(image: Column) -> Column:
    """Fields of the image's header as a map of strings."""
    run = lambda x: pa.array([list((C.bmp_header(v) or C.HeaderReader(C.HeaderWriter().to_bytes())).as_strings().items()) for v in x.to_pylist()], pa.map_(pa.string(), pa.string()))
    return F.arrow_udf(run, "map<string,string>")(image)


def has_header(image: Column) -> Column:
    return F.arrow_udf(lambda x: pa.array([C.bmp_header(v) is not None for v in x.to_pylist()], pa.bool_()), "boolean")(image)


def unpacked(decoded: DataFrame) -> DataFrame:
    """Entries of the decoded archives (those with ``packed``)."""
    kind = pa.list_(pa.struct([("relative_path", pa.string()), ("data", pa.binary())]))
    run = F.arrow_udf(lambda x: pa.array([[{"relative_path": p, "data": d} for p, d in unpack_entries(v)] for v in x.to_pylist()], kind), "array<struct<relative_path:string,data:binary>>")
    return decoded.filter("packed and error is null").select("filename", F.explode(run("content")).alias("e")).select("filename", "e.*")

