"""One measurement contract for windows, crops, tokens, masks and normalisation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ClipConfig:
    """Clip geometry and preprocessing; the same values serve every stage.

    The defaults give 16 frames of 112 x 112 pixels as 8 x 14 x 14 tokens.
    """

    num_frames: int = 16
    img_size: int = 112
    tubelet_size: int = 2
    patch_size: int = 8
    windows: int = 3
    foreground_crop: bool = True
    foreground_threshold: int = 8
    foreground_margin: float = 0.15
    crop_scale: tuple[float, float] = (1.0, 1.0)
    flip_probability: float = 0.0
    input_mean: float = 0.5
    input_std: float = 0.5
    min_context_tokens: int = 1
    seed: int = 0

    def __post_init__(self):
        if self.num_frames % self.tubelet_size or self.img_size % self.patch_size:
            raise ValueError("tubelet and patch sizes must divide the clip")
        if self.input_std <= 0 or self.windows < 1:
            raise ValueError("input_std and windows must be positive")
        if not 0.0 <= self.flip_probability <= 1.0:
            raise ValueError("flip_probability must lie between zero and one")

    @property
    def grid(self) -> tuple[int, int, int]:
        side = self.img_size // self.patch_size
        return self.num_frames // self.tubelet_size, side, side

    @property
    def tokens(self) -> int:
        steps, rows, columns = self.grid
        return steps * rows * columns
