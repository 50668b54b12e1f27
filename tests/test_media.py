"""Image and sound analysis on made signals."""

import numpy as np
import pytest

from lumenshelf.operators import media


def grey(plane):
    return np.clip(np.round(plane), 0, 255).astype(np.uint8)[:, :, None]


def test_a_flat_image_tiles_and_has_no_direction():
    found = media.image_features(grey(np.full((64, 64), 120)))
    assert found["tileability"] == 1 and found["tile_class"] == "seamless" and found["class"] == "texture" and found["phash"] == 0
    assert found["colours"] == ["#787878"] and not any(found["vec"])


def test_a_hard_seam_does_not_tile():
    found = media.image_features(grey(np.tile(np.linspace(0, 255, 64), (64, 1))))
    assert found["tileability"] < 0.5 and found["class"] == "photo"
    assert media.image_features(grey(np.tile(np.linspace(255, 0, 64), (64, 1))))["phash"] == -1  # every cell brighter than the next


def test_likeness_survives_brightness_and_size():
    plane = np.add.outer(np.sin(np.arange(96) / 9) * 60, np.cos(np.arange(96) / 13) * 50) + 120
    a, b = media.image_features(grey(plane)), media.image_features(grey(plane[::2, ::2] + 15))
    assert np.dot(a["vec"], b["vec"]) > 0.99 and bin((a["phash"] ^ b["phash"]) & (1 << 64) - 1).count("1") <= 4


def test_period_and_colours():
    stripes = np.tile((np.arange(128) % 16 < 8) * 200.0, (128, 1))
    found = media.image_features(grey(stripes))
    assert found["repeat_period"] == 16 and found["tile_class"] == "tiled"
    picture = np.zeros((40, 40, 4), np.uint8)
    picture[:, :30] = (250, 10, 10, 255)
    picture[:, 30:] = (10, 10, 250, 0)
    found = media.image_features(picture)
    assert found["colours"][0] == "#fa0a0a" and found["class"] == "sprite"


def slow_period(signal):
    rest = signal - signal.mean()
    best = max(range(2, len(rest) // 2), key=lambda lag: (rest[: len(rest) - lag] * rest[lag:]).sum())
    value = (rest[: len(rest) - best] * rest[best:]).sum() / (rest * rest).sum()
    return best if value >= media.REPEATS else None


def test_period_against_all_lags():
    rng = np.random.default_rng(1)
    for k in range(40):
        signal = rng.standard_normal(60) * 0.4 + np.sin(np.arange(60) * 2 * np.pi / (4 + k % 12)) * (k % 3)
        assert media.period(signal) == slow_period(signal)


RATE = 22050


def tone(hertz, seconds):
    return np.sin(2 * np.pi * hertz * np.arange(int(RATE * seconds)) / RATE) * 0.5


@pytest.mark.parametrize(("hertz", "key"), [(440, "A"), (261.63, "C"), (311.13, "D#")])
def test_a_steady_tone_is_a_loop_in_its_key(hertz, key):
    found = media.sound_features(tone(hertz, 2), RATE)
    assert found["musical_key"] == key and found["is_loop"] and found["class"] == "loop"


def test_a_decaying_click_is_a_one_shot():
    x = np.random.default_rng(0).standard_normal(RATE // 2) * np.exp(-np.arange(RATE // 2) / 800)
    found = media.sound_features(x * 0.5, RATE)
    assert found["class"] == "one_shot" and not found["is_loop"] and found["onsets"] <= 1


def test_beats():
    x = np.zeros(RATE * 8)
    for k in range(16):  # two a second
        x[k * RATE // 2 : k * RATE // 2 + 400] = np.random.default_rng(0).standard_normal(400) * 0.5
    found = media.sound_features(x, RATE)
    assert found["bpm"] == pytest.approx(120, rel=0.04) and 12 <= found["onsets"] <= 18 and found["class"] == "sfx"


def test_silence_and_odd_rows(spark):
    assert media.sound_features(np.zeros(5000), RATE)["musical_key"] is None
    rows = [(1, RATE, (tone(440, 1) * 32767).astype("<i2").tobytes()), (2, None, b"12"), (3, RATE, None), (None, RATE, b"\0")]
    got = {r["id"]: r for r in media.sound_table(spark.createDataFrame(rows, "id long, rate int, data binary")).collect()}
    assert got[1]["musical_key"] == "A" and got[2]["class"] is got[3]["class"] is got[None]["class"] is None
    images = [(1, 8, 8, 1, bytes(64), False), (2, 8, 8, 1, b"1", False), (3, None, None, None, None, None), (4, 2, 2, 3, bytes([9, 0, 200] * 4), True)]
    got = {r["id"]: r for r in media.image_table(spark.createDataFrame(images, "id long, height int, width int, channels int, data binary, bgr boolean")).collect()}
    assert got[1]["class"] == "texture" and got[2]["phash"] is got[3]["phash"] is None and got[4]["colours"] == ["#c80009"]


def test_images_by_sparks_reader(spark, tmp_path):
    """A bitmap written by hand, read by Spark's image source."""
    import struct

    width, height = 20, 12
    rows = b"".join(bytes([30, 60, 90] * width).ljust((3 * width + 3) // 4 * 4, b"\0") for _ in range(height))
    head = struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 2835, 2835, 0, 0)
    (tmp_path / "a.bmp").write_bytes(head + rows)
    found = media.image_table(media.read_images(spark, str(tmp_path))).collect()
    assert len(found) == 1 and found[0]["colours"] == ["#5a3c1e"]


def test_continuous_features_of_fixed_sounds():
    """A pure tone, noise and silence: values known beforehand."""
    rate = 8000
    t = np.arange(2 * rate) / rate
    tone = media.sound_features(0.5 * np.sin(2 * np.pi * 440 * t), rate)
    noise = media.sound_features(np.random.default_rng(1).uniform(-0.5, 0.5, 2 * rate), rate)
    silence = media.sound_features(np.zeros(rate), rate)
    assert tone["musical_key"] == "A" and abs(tone["loudness_db"] - 20 * np.log10(0.5 / np.sqrt(2))) < 0.01
    assert abs(tone["brightness"] - 440 / 4000) < 0.02 and tone["harmonicity"] > 0.9 > 0.5 > noise["harmonicity"]
    assert abs(noise["brightness"] - 0.5) < 0.05
    assert (silence["loudness_db"], silence["brightness"], silence["harmonicity"], silence["loopability"]) == (-100.0, 0.0, 0.0, 0.0)
    assert tone["is_loop"] and tone["loopability"] > 0.62


def test_results_leave_in_small_parts(spark):
    """A batch of thousands of images is not held with all of its features."""
    held = []
    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "8 AS height", "8 AS width", "1 AS channels", "CAST(repeat('x', 64) AS BINARY) AS data", "false AS bgr")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(media, "map_arrow", lambda df, run, schema: held.extend(b.num_rows for b in run(iter(df.toArrow().to_batches()))))
        media.image_table(rows)
    assert sum(held) == 1000 and max(held) <= 128
