import numpy as np
import pytest

from tessera.functions import signal as s

RATE = s.SAMPLE_RATE


def sine(hz, seconds=1.0, amp=0.5):
    return (amp * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)).astype(np.float32)


def test_levels_and_centroid_of_a_sine():
    d = s.describe(sine(1000))
    assert d.peak_db == pytest.approx(-6.02, abs=0.05)
    assert d.rms_db == pytest.approx(-9.03, abs=0.05)
    assert d.spectral_centroid == pytest.approx(1000, abs=15)
    assert d.spectral_flatness < 0.05
    assert d.zero_crossing == pytest.approx(2000 / RATE, rel=0.02)


def test_loudness_reference():
    # A full-scale 997 Hz sine reads -3.01 LUFS in one channel.
    assert s.loudness(sine(997, 2.0, 1.0)) == pytest.approx(-3.01, abs=0.1)
    assert s.loudness(np.zeros(RATE)) is None


def test_noise_is_flat_and_has_no_key():
    x = np.random.default_rng(0).uniform(-0.5, 0.5, RATE).astype(np.float32)
    d = s.describe(x)
    assert d.spectral_flatness > 0.3
    assert d.key_root is None


def test_triads():
    c_major = sum(sine(f, 2.0, 0.2) for f in (261.63, 329.63, 392.0))
    a_minor = sum(sine(f, 2.0, 0.2) for f in (220.0, 261.63, 329.63))
    assert s.key(*s.chroma(c_major))[:2] == (0, 1)
    assert s.key(*s.chroma(a_minor))[:2] == (9, 0)
    assert s.key(*s.chroma(sine(440, 2.0)))[:2] == (9, None)


def clicks(every, seconds=8.0):
    x = np.zeros(int(RATE * seconds), np.float32)
    burst = np.random.default_rng(1).uniform(-1, 1, 480)
    for at in np.arange(0, len(x) - 480, int(every * RATE)):
        x[at : at + 480] = burst
    return x


def test_tempo_and_onsets():
    d = s.describe(clicks(0.5))
    assert any(d.bpm == pytest.approx(b, rel=0.03) for b in (60, 120))
    assert s.describe(clicks(0.125, 2.0)).onset_density > s.describe(clicks(0.5, 2.0)).onset_density


def test_short_and_empty():
    d = s.describe(np.zeros(10, np.float32))
    assert d.spectral_centroid is None
    assert d.peak_db == pytest.approx(-200)
    assert s.peaks(np.zeros(0), 3) == [(0.0, 0.0)] * 3
    assert s.peaks(np.arange(4.0), 2) == [(0.0, 1.0), (2.0, 3.0)]
    assert len(s.peaks(np.arange(2.0), 5)) == 5


def test_standardize():
    raw = s.MEAN.copy()
    raw[0], raw[1], raw[2] = np.inf, np.nan, s.MEAN[2] + 100 * s.STD[2]
    z = s.standardize(raw)
    assert z[0] == 0 and z[1] == 0 and z[2] == 5 and not z[3:].any()


def test_mel_and_vector():
    x = sine(440, 0.5)
    bands = s.log_mel(x)
    assert bands.shape == (s.MEL_FRAMES, s.MEL_BINS)
    v = s.raw_vector(x, bands)
    assert v.shape == (s.WIDTH,) and np.isfinite(v).all()
    assert v[-1] == 0 and s.raw_vector(sine(440, 10.0), s.log_mel(sine(440, 10.0)))[-1] == 1
    assert s.filterbank().shape == (64, 513) and (s.filterbank().sum(axis=1) > 0).all()
    assert np.allclose(s.dct() @ s.dct().T, np.eye(20))
