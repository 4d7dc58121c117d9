import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import frames
from strophe.sources import audio, exports
from strophe.streaming import progress

SIZE, HOP, RATE = 64, 32, 2_000.0


@pytest.fixture(scope="module")
def signal():
    rng = np.random.default_rng(5)
    return {"a": np.sin(np.arange(500) * 0.7) + rng.normal(0, 0.1, 500), "b": rng.normal(0, 1, 40), "silent": np.zeros(130)}


@pytest.fixture(scope="module")
def spectra(spark, signal):
    rows = spark.createDataFrame([(k, i, float(x)) for k, v in signal.items() for i, x in enumerate(v)], "t string, i long, x double")
    return frames.cut(rows, "t", "i", "x", SIZE, HOP).withColumn("spectrum", frames.magnitudes("samples")).persist()


def plain(x):
    n = 1 if len(x) <= SIZE else 1 + -(-(len(x) - SIZE) // HOP)
    x = np.concatenate([x, np.zeros(SIZE)])
    cut = np.array([x[HOP * k : HOP * k + SIZE] for k in range(n)])
    return cut, np.abs(np.array([[sum(f * np.hanning(SIZE) * np.exp(-2j * np.pi * b * np.arange(SIZE) / SIZE)) for b in range(SIZE // 2 + 1)] for f in cut]))


def by_frame(df, column):
    out = {}
    for r in df.select("t", "frame", column).orderBy("t", "frame").collect():
        out.setdefault(r.t, []).append(r[2])
    return {k: np.array(v) for k, v in out.items()}


def test_cut_and_spectrum(spectra, signal):
    cut, spectrum = by_frame(spectra, "samples"), by_frame(spectra, "spectrum")
    for k, x in signal.items():
        want, mags = plain(x)
        assert np.allclose(cut[k], want) and np.allclose(spectrum[k], mags, atol=1e-9)


def test_onset_chroma_cepstrum(spectra, signal):
    onset = by_frame(frames.onset_envelope(spectra, "t", RATE, SIZE), "onset")
    chroma = by_frame(frames.chroma(spectra, "t", RATE, SIZE), "chroma")
    cepstrum = by_frame(frames.with_deltas(spectra.withColumn("c", frames.cepstrum(RATE, SIZE)("spectrum")), "t", "c"), "c")
    over = lambda v: v / v.max() if v.max() > 0 else v
    for k, x in signal.items():
        m = plain(x)[1]
        db = 10 * np.log10(np.maximum(m**2 @ frames.mel_filters(RATE, SIZE, 128).T, 1e-10))
        db = np.maximum(db, db.max() - 80)
        rise = [0.0] + [np.maximum(b - a, 0).mean() for a, b in zip(db, db[1:], strict=False)]
        assert np.allclose(onset[k], over(np.array(rise)), atol=1e-8)
        c = np.zeros((len(m), 12))
        for b in range(1, m.shape[1]):
            if 50 <= b * RATE / SIZE <= 5000:
                c[:, round(12 * np.log2(b * RATE / SIZE / 440) + 9) % 12] += m[:, b]
        c = np.array([over(v) for v in c])
        assert np.allclose(chroma[k], [over(np.median(c[max(0, f - 2) : f + 3], axis=0)) for f in range(len(c))], atol=1e-8)
        e = np.log(np.maximum(m**2 @ frames.mel_filters(RATE, SIZE, 40).T, 1e-10))
        d = np.array([[sum(v[j] * np.cos(np.pi * q * (j + 0.5) / 40) for j in range(40)) for q in range(13)] for v in e])
        at = lambda f: d[min(max(f, 0), len(d) - 1)]
        assert np.allclose(cepstrum[k], [np.concatenate([d[f], (at(f + 1) - at(f - 1)) / 2]) for f in range(len(d))], atol=1e-6)


def test_wav_files(spark, tmp_path):
    data = np.array([[1000, 3000], [-2000, 2000], [32767, 32767]], "<i2")
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000), w.writeframes(data.tobytes())
    (tmp_path / "y.wav").write_bytes(b"RIFF....WAVEjunk")
    (tmp_path / "z.txt").write_bytes(b"ID3 tag")
    files = audio.files(spark, f"file://{tmp_path}")
    assert {r.path[-5:]: (r.format, r.supported) for r in files.collect()} == {"x.wav": ("wav", True), "y.wav": ("wav", True), "z.txt": ("mp3", False)}
    blocks = audio.wav_blocks(files.where("supported"))
    assert [r.path[-5:] for r in blocks.where("error IS NOT NULL").collect()] == ["y.wav"]
    assert [(r.which, r.x) for r in audio.samples(blocks).orderBy("which").collect()] == [(0, 2000 / 32768), (1, 0.0), (2, 32767 / 32768)]


def test_documents_round_trip(spark, tmp_path):
    spans = spark.createDataFrame([("a", 1.0, 1.0, 0.5), ("a", 0.0, 1.0, 0.4), ("b", 0.0, 2.0, None)], "t string, start double, duration double, confidence double")
    docs = exports.nested("t", {"bars": spans.where("t = 'a'"), "beats": spans}, ["start", "duration", "confidence"])
    exports.write_documents(docs, f"{tmp_path}/out")
    (tmp_path / "out" / "more.json").write_text("{broken\n")
    back = exports.read_documents(spark, f"{tmp_path}/out", docs.schema).cache()
    assert sorted(map(str, back.where("corrupt IS NULL").select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert back.where("corrupt IS NOT NULL").count() == 1
    assert spark.range(1).select(exports.milliseconds(F.lit(0.0125))).first()[0] == 13


def test_progress_never_falls(spark, tmp_path):
    for k, rows in enumerate([[("a", 10.0), ("b", 120.0)], [("a", 5.0), ("c", None)], [("a", 50.0)]]):
        spark.createDataFrame(rows, "track string, percent double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("track string, percent double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = progress.monotone(stream).writeStream.outputMode("update").format("memory").queryName("progress").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    assert run.awaitTermination(120)
    got = {}
    for r in spark.table("progress").collect():
        got.setdefault(r.track, []).append(r.percent)
    assert sorted(got["a"])[-1] == 50.0 and len(got["a"]) == 3 and got["b"] == [100.0] and got["c"] == [0.0]


def test_blocks_with_halo_give_what_whole_tracks_give(spark, monkeypatch):
    """Frames and medians over block borders, with blocks of a few frames."""
    rng = np.random.default_rng(8)
    signal = {"long": rng.normal(0, 1, 1500), "short": rng.normal(0, 1, 3), None: rng.normal(0, 1, 200)}
    rows = spark.createDataFrame([(k, i, float(x)) for k, v in signal.items() for i, x in enumerate(v)], "t string, i long, x double")
    monkeypatch.setattr(frames, "FRAMES", 3)
    monkeypatch.setattr(frames, "BLOCK", 5)
    for size, hop in ((SIZE, HOP), (SIZE, 5)):
        cut = by_frame(frames.cut(rows, "t", "i", "x", size, hop), "samples")
        for k, x in signal.items():
            n = 1 if len(x) <= size else 1 + -(-(len(x) - size) // hop)
            padded = np.concatenate([x, np.zeros(size)])
            assert np.allclose(cut[k], [padded[hop * i : hop * i + size] for i in range(n)])
    spectra = frames.cut(rows, "t", "i", "x", SIZE, HOP).withColumn("spectrum", frames.magnitudes("samples"))
    split = frames.separated(spectra, "t", r=4, bins=2, percussive_margin=2.0, power=2.0)
    got = {name: by_frame(split, name) for name in ("spectrum", "harmonic", "percussive")}
    ratios = {r.t: r for r in frames.energy_ratios(split, "t").collect()}
    for k, m in got["spectrum"].items():
        h = np.array([[np.median(m[max(0, i - 4) : i + 5, b]) for b in range(m.shape[1])] for i in range(len(m))]) ** 2
        p = (np.array([[np.median(m[i, max(0, b - 2) : b + 3]) for b in range(m.shape[1])] for i in range(len(m))]) / 2) ** 2
        assert np.allclose(got["harmonic"][k], m * h / (h + p + 1e-12)) and np.allclose(got["percussive"][k], m * p / (h + p + 1e-12))
        assert ratios[k].harmonic_ratio == pytest.approx((got["harmonic"][k] ** 2).sum() / (m**2).sum())
    parts = frames.part_features(split, "t", RATE, SIZE)
    onset = by_frame(parts, "percussive_onset")
    alone = by_frame(frames.onset_envelope(split, "t", RATE, SIZE, "percussive"), "onset")
    assert all(np.allclose(onset[k], alone[k]) for k in onset)
    assert not frames.separated(spectra.limit(0), "t").collect()
