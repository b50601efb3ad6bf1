"""Every sample is in a frame."""

import numpy as np

from quire.llm import audio


def test_last_samples_are_in_a_frame():
    filters = audio.mel_filters(audio.RATE)
    for n in (1, 239, 240, 241, 359, 360, 361, 960, 999):
        x = np.random.default_rng(n).integers(-2000, 2000, n).astype(np.float32)
        mel, energy = audio.log_mel(x, filters)
        assert len(mel) == len(energy) and (len(mel) - 1) * audio.HOP + audio.FRAME >= n
        assert len(mel) == 1 or (len(mel) - 2) * audio.HOP + audio.FRAME < n
    x = np.full(960, 900, np.float32)
    y = x.copy()
    y[930:] = -450
    assert not np.array_equal(audio.log_mel(x, filters)[0], audio.log_mel(y, filters)[0])
