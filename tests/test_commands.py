import random
import zipfile

import pytest

from octetflow.commands import main


@pytest.fixture
def here(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"abc")
    (tmp_path / "in" / "sub" / "b.bin").write_bytes(random.Random(1).randbytes(5000))
    (tmp_path / "pw").write_text("password\n")
    return tmp_path


def run(spark, *args):
    return main([str(a) for a in args], spark)


def tree(at):
    return {str(p.relative_to(at)): p.read_bytes() for p in at.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_hash(spark, here, capsys):
    assert run(spark, "hash", here / "in" / "a.txt") == 0 and run(spark, "hash", here / "in" / "a.txt", "--crc", "--sha") == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "xxHash64: 78AF5F94892F3950" and out[1].startswith("SHA-256: ba7816bf") and out[2] == "CRC32: 352441C2"
    assert run(spark, "hash", here / "in", "-ei", "-sp", here) == 0
    assert capsys.readouterr().out.startswith("Folder Hash: ")
    lines = "".join(p.read_text() for p in sorted((here / "in_hash_info.txt").glob("part-*"))).splitlines()
    assert lines[2] == "Total Files: 2" and lines[4] == "a.txt"
    assert run(spark, "hash", here / "nothing") == 1


def test_pack_and_unpack(spark, here):
    assert run(spark, "pack", here / "in", "-sp", here) == 0
    assert run(spark, "unpack", here / "in.cfup", "out", "-sp", here) == 0
    assert tree(here / "out") == tree(here / "in")
    with zipfile.ZipFile(here / "z.zip", "w") as z:
        for name, data in tree(here / "in").items():
            z.writestr(name, data)
    assert run(spark, "ztc", here / "z.zip", "-sp", here) == 0
    assert (here / "z.cfup").read_bytes() == (here / "in.cfup").read_bytes()


def test_compress(spark, here, capsys):
    src = here / "in" / "sub" / "b.bin"
    assert run(spark, "compress", src, 9, "-sp", here) == 0 and run(spark, "decompress", here / "b.cfmp", "back", "-sp", here) == 0
    assert (here / "back").read_bytes() == src.read_bytes()
    assert run(spark, "compress", src, 22, "-sp", here) == 1 and "levels are 1 to 21" in capsys.readouterr().err


def test_diff_and_patch(spark, here):
    src = here / "in" / "sub" / "b.bin"
    (here / "new").write_bytes(src.read_bytes()[:3000] + b"more" + src.read_bytes()[3000:])
    assert run(spark, "diff", src, here / "new", "p", "-sp", here) == 0 and run(spark, "patch", src, here / "p", "made", "-sp", here) == 0
    assert (here / "made").read_bytes() == (here / "new").read_bytes()
    assert run(spark, "patch", here / "in" / "a.txt", here / "p", "bad", "-sp", here) == 1 and not (here / "bad").exists()


def test_shares(spark, here):
    src = here / "in" / "sub" / "b.bin"
    assert run(spark, "split", src, "-n", 4, "-k", 2, "-sp", here) == 0
    assert run(spark, "integrate", "back", here / "b_split_4.cfs", here / "b_split_2.cfs", "-sp", here) == 0
    assert (here / "back").read_bytes() == src.read_bytes()
    assert run(spark, "integrate", "no", here / "b_split_4.cfs", "-sp", here) == 1
    assert run(spark, "split", src, "-n", 2, "-k", 3) == 1


@pytest.mark.parametrize("options", [["-ne"], ["-c", 8, "-ne", "-gs", "--sha"], ["--password-file"], ["-2f", "--crc"], ["-2f", "-c", 2]])
def test_images(spark, here, options):
    secret = options == ["--password-file"]
    given = [*options, here / "pw"] if secret else options
    extra = ["--password-file", here / "pw"] if secret else []
    for source in (here / "in", here / "in" / "a.txt"):
        assert run(spark, "encode", source, "-sp", here / "img", *given) == 0
    names = sorted(p.name for p in (here / "img").iterdir() if p.suffix == ".bmp")
    assert len(names) == 2
    for name in names:
        assert run(spark, "decode", here / "img" / name, "-sp", here / "back", *extra) == 0
    assert tree(here / "back") == {"a.txt": b"abc", **{f"in/{k}": v for k, v in tree(here / "in").items()}}
    if secret:
        (here / "pw").write_text("wrong")
        assert run(spark, "decode", here / "img" / names[0], "-sp", here / "bad", *extra) == 1 and not (here / "bad").exists()
