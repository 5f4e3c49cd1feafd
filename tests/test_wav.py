import io
import struct
import wave

import numpy as np
import pytest

from verselake.sources import wav


def file(width, channels, x, rate=8000, code=None, length=None, extra=b"", extended=False):
    """A WAV file of frames x (n, channels) in -1..1, written by hand."""
    if code == wav.REAL:
        data = x.astype("<f4").tobytes()
    elif width == 1:
        data = (np.round(x * 127) + 128).astype(np.uint8).tobytes()
    else:
        whole = np.round(x * (2 ** (8 * width - 1) - 1)).astype("<i8")
        data = np.frombuffer(whole.tobytes(), np.uint8).reshape(*x.shape, 8)[..., :width].tobytes()
    form = struct.pack("<HHIIHH", wav.EXTENDED if extended else code or 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    if extended:
        form += struct.pack("<HHIH", 22, 8 * width, 0, code or 1) + bytes(14)
    size = len(data) if length is None else length
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", size) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_formats():
    x = np.random.default_rng(1).uniform(-0.9, 0.9, (500, 2))
    for width, code, tolerance in ((1, 1, 0.015), (2, 1, 1e-4), (3, 1, 1e-6), (4, 1, 1e-6), (4, wav.REAL, 1e-6)):
        for extended in (False, True):
            data = file(width, 2, x, code=code, extra=b"LIST\x03\0\0\0abc\0", extended=extended)
            form = wav.read_format(io.BytesIO(data), len(data), "x")
            assert (form.rate, form.channels, form.count) == (8000, 2, 500)
            got = form.decoded(data[form.offset : form.offset + form.count * width * 2])
            assert np.abs(got - x.mean(axis=1)).max() < tolerance
    for length in (0, 0xFFFFFFFF, 10_000):
        data = file(2, 1, x[:, :1], length=length)
        assert wav.read_format(io.BytesIO(data), len(data), "x").count == 500
    for bad in (b"", b"RIFF\0\0\0\0WAVE", b"OggS" + bytes(60), file(2, 1, x[:, :1], code=7), file(2, 1, x[:, :1])[:30]):
        with pytest.raises(ValueError):
            wav.read_format(io.BytesIO(bad), len(bad), "x")


def test_read_and_write(spark, tmp_path):
    rng, folder = np.random.default_rng(2), str(tmp_path / "in")
    (tmp_path / "in" / "sub").mkdir(parents=True)
    clips = {"long": rng.uniform(-0.9, 0.9, 40_000), "short": rng.uniform(-0.9, 0.9, 30), "bytes": rng.uniform(-0.9, 0.9, 9000), "none": np.zeros(0)}
    for name, x in clips.items():
        (tmp_path / "in" / ("sub" if name == "short" else "") / f"{name}.wav").write_bytes(file(1 if name == "bytes" else 2, 1, x[:, None]))
    (tmp_path / "in" / "notes.txt").write_text("no sound")
    wav.register(spark)
    df = spark.read.format("wav").option("piece", 1000).load(folder)
    rows = df.collect()
    assert df.rdd.getNumPartitions() > 20 and max(len(r.samples) for r in rows) <= 1000 and {r.rec_id for r in rows} == {"long", "short", "bytes"}
    for name, x in clips.items():
        parts = sorted((r.first, r.samples) for r in rows if r.rec_id == name)
        whole = np.concatenate([p for _, p in parts]) if parts else np.zeros(0)
        assert [a for a, _ in parts] == list(range(0, len(x), 1000)) and np.abs(whole - x).max(initial=0) < (0.015 if name == "bytes" else 1e-4)
    out = str(tmp_path / "out")
    some = df.filter("not (rec_id = 'long' and first = 5000)").repartition(5)
    wav.write(some, out, 8000)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["bytes.wav", "long.wav", "short.wav"]
    with wave.open(f"{out}/long.wav") as f:
        back = np.frombuffer(f.readframes(f.getnframes()), "<i2") / 32767
        assert (f.getframerate(), f.getnchannels(), f.getnframes()) == (8000, 1, 40_000)
    assert np.abs(back[:5000] - clips["long"][:5000]).max() < 1e-3 and not back[5000:6000].any() and np.abs(back[6000:] - clips["long"][6000:]).max() < 1e-3
    again = {r.rec_id: r.n for r in spark.read.format("wav").load(out).selectExpr("rec_id", "size(samples) as n").collect()}
    assert again == {"long": 40_000, "short": 30, "bytes": 9000}
    wav.write(df.filter("rec_id = 'short'"), out, 8000, "overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["short.wav"]
    with pytest.raises(Exception):
        spark.read.format("wav").load(str(tmp_path / "gone")).collect()
