from octetflow.functions import chacha as C


def test_ietf_vector():
    """RFC 8439, 2.4.2."""
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    out = C.chacha20(bytes(range(32)), bytes.fromhex("000000000000004a00000000"), text, 1)
    assert out.hex().startswith("6e2e359a2568f98041ba0728dd0d6981e97e7aec1d4360c20a27afccfd9fae0b") and out.hex().endswith("5af90bbf74a35be6b40b8eedf2785e42874d")


def test_subkey_vector():
    """draft-irtf-cfrg-xchacha, 2.2.1."""
    out = C.hchacha20(bytes(range(32)), bytes.fromhex("000000090000004a0000000031415927"))
    assert out.hex() == "82413b4227b27bfed30e42508a877d73a0f9e4d58a74a853c12ec41326d3ecdc"


def test_any_place():
    key, nonce, data = bytes(range(32)), bytes(range(24)), bytes(1000)
    whole = C.xchacha20(key, nonce, data)
    assert whole[640:] == C.xchacha20(key, nonce, data[640:], 10)
    assert C.xchacha20(key, nonce, whole) == data and C.xchacha20(key, nonce, b"") == b""


def test_batches():
    key, data = bytes(32), bytes(C.BATCH + 100)
    out = C.batch_cipher(key, data)
    assert C.batch_cipher(key, out) == data
    assert out[C.BATCH :] == C.chacha20(key, (1).to_bytes(8, "little") + bytes(4), bytes(100))
    assert out[:100] == C.chacha20(key, bytes(12), bytes(100)) and C.batch_cipher(key, b"") == b""
