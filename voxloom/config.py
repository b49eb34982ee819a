"""All tunables of corpus preparation in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal the numbers existing corpora and models were made with.
SAMPLE_RATE = 24_000
N_CODEBOOKS = 32
AUDIO_VOCAB = 2_051
CHUNK_ROWS = 1_000
DEFAULT_SPEAKER = "999"
MIN_TEXT_CHARS = 10
SAMPLER_SEED = 42
SUBSAMPLE_DIVISOR = 16

# The one measured run that time estimates are scaled from.
MEASURED_AUDIO_HOURS = 1084.69
MEASURED_WALL_HOURS = 12.53

# Hours of audio per published corpus subset.
SUBSET_HOURS = {
    "clean": 5987.71,
    "clean_sa": 1084.69,
    "dirty": 21791.63,
    "dirty_sa": 2223.17,
    "microset": 1.32,
    "test": 59.80,
    "validation": 33.16,
}


@dataclass(frozen=True)
class PipelineConfig:
    """Settings shared by every stage.

    ``position_block`` bounds the rows any one task ever sorts when a dense global position is
    assigned; ``broadcast_rows`` is the largest row count a side may have to be broadcast.
    """

    sample_rate: int = SAMPLE_RATE
    n_codebooks: int = N_CODEBOOKS
    audio_vocab: int = AUDIO_VOCAB
    chunk_rows: int = CHUNK_ROWS
    default_speaker: str = DEFAULT_SPEAKER
    omit_speaker: bool = False
    strict_null_speaker: bool = False
    min_text_chars: int = MIN_TEXT_CHARS
    batch_size: int = 8
    grad_acc_steps: int = 1
    seed: int = SAMPLER_SEED
    position_block: int = 1 << 20
    chunks_per_task: int = 16
    broadcast_rows: int = 200_000

    @property
    def frame_width(self) -> int:
        """Slots of a frame: one per codebook, then the text slot."""
        return self.n_codebooks + 1

    @property
    def text_slot(self) -> int:
        return self.n_codebooks


DEFAULT = PipelineConfig()
