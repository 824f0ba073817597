"""Speaking pieces with a voice and checking what was heard, in tasks."""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quire.functions.speech import matching_ratio
from quire.functions.text import CHARACTER_SECONDS, FRAME_RATE, LEAST_FRAMES, LEAST_SIMILARITY
from quire.operators.narration import pcm, wav
from quire.operators.providers import ModelError

RETAKES = 3
TAKES = "piece_key string, text string, heard string, score double, data binary"


class Voice(Protocol):
    """What a speech model and a listening one offer; sound is an array of numbers from -1 to 1."""

    def speak(self, texts: list[str], seed: int, most_frames: int) -> list[np.ndarray]: ...

    def hear(self, sound: np.ndarray) -> str: ...


_loaded: dict[object, Voice] = {}


class Silent:
    """A voice that needs no model: silence of a length in proportion to the text, and hears what it said."""

    def __init__(self):
        self.said: dict[bytes, str] = {}

    def speak(self, texts: list[str], seed: int, most_frames: int) -> list[np.ndarray]:
        sounds = []
        for text in texts:
            sound = np.zeros(len(text) + 8, np.float32)
            mark = hashlib.sha256(text.encode()).digest()[:8]  # which text it is, in the first samples
            sound[:8] = [int(b) / 32767 + 1e-6 for b in mark]
            self.said[pcm(sound)[:8].tobytes()] = text
            sounds.append(sound)
        return sounds

    def hear(self, sound: np.ndarray) -> str:
        return self.said.get(sound[:8].tobytes(), "")


_voices: dict[str, Callable[[], Voice]] = {"silent": Silent}


def register_voice(name: str, load: Callable[[], Voice]) -> None:
    """Makes a voice known by a name; load runs in each worker that speaks."""
    _voices[name] = load


def voice_loader(name: str) -> Callable[[], Voice]:
    """A registered voice, or what ``module:name`` names."""
    if name in _voices:
        return _voices[name]
    module, _, own = name.partition(":")
    if not own:
        raise ModelError(f"no voice {name}; there are: {', '.join(sorted(_voices))}")
    try:
        return getattr(importlib.import_module(module), own)
    except (ImportError, AttributeError) as e:
        raise ModelError(f"voice {name}: {e}") from None


def loaded(load: Callable[[], Voice], name: object) -> Voice:
    """A worker's voice of this name, loaded once."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def most_frames(texts: list[str]) -> int:
    """frame_cap of the longest of some texts."""
    seconds = len(max(texts, key=len)) * CHARACTER_SECONDS
    return max(LEAST_FRAMES, int(seconds * FRAME_RATE))


def _take(voice: Voice, text: str, sound: np.ndarray) -> tuple[float, np.ndarray, str]:
    samples = pcm(sound)
    heard = voice.hear(samples)
    return matching_ratio(text, heard), samples, heard


def best_of(voice: Voice, text: str, seed: int, first: np.ndarray) -> tuple[float, np.ndarray, str]:
    """The first take, or if it isn't good enough the best of it and up to RETAKES more, alone and with other seeds; of equal ones the earlier."""
    best = _take(voice, text, first)
    for attempt in range(1, RETAKES + 1):
        if best[0] >= LEAST_SIMILARITY:
            break
        again = _take(voice, text, voice.speak([text], seed + attempt, most_frames([text]))[0])
        if again[0] > best[0]:
            best = again
    return best


def spoken_by(load: Callable[[], Voice], name: str) -> Callable[[DataFrame], DataFrame]:
    """A ``speak`` for quire.plans.books.narrate: batches of similar length go through the voice together. The result is to be written before use."""

    def speak(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, own in rows.groupby(["window", "batch"], sort=False):
                voice = loaded(load, name)
                own = own.sort_values("place")
                texts = own["text"].tolist()
                sounds = voice.speak(texts, int(own["seed"].iloc[0]), most_frames(texts))
                takes = [best_of(voice, t, int(s), x) for t, s, x in zip(texts, own["seed"], sounds, strict=True)]
                yield pd.DataFrame({"piece_key": own["piece_key"].tolist(), "text": texts, "heard": [t[2] for t in takes], "score": [t[0] for t in takes], "data": [wav(t[1]) for t in takes]})

    return lambda pieces: pieces.repartition("window", "batch").sortWithinPartitions("window", "batch", "place").select("piece_key", "text", "seed", "window", "batch", "place").mapInPandas(speak, TAKES)
