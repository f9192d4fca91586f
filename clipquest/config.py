"""Run parameters, with one preset per way of asking and parsing."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

STRICT = "strict"
LENIENT = "lenient"

# Defaults and caps of the three presets.
FRAMES_PER_QUESTION = 12
RADIUS_SECONDS = 2.0
MAX_FRAMES_STRICT = 16
MAX_FRAMES_LENIENT = 24
FRAMES_SENT_STRICT = 16
FRAMES_SENT_LENIENT = 12
FRAMES_SENT_REMOTE = 20
FRAMES_SENT_RETRY = 6
MAX_NEW_TOKENS_STRICT = 256
MAX_NEW_TOKENS_LENIENT = 128


@dataclass(frozen=True)
class EvalConfig:
    """What one evaluation run needs to know besides its tables.

    ``mode`` selects the reply rules; ``chat`` the shape of the messages.
    ``two_field`` says how ``AA:BB`` is read: ``hhmm`` (default) or ``mmss``.
    ``on_bad_video`` is ``row`` (an error on the affected rows) or ``fail``.
    """

    mode: str
    chat: str
    backend: str
    videos_dir: str = "videos"
    model_id: str | None = None
    frames_per_question: int = FRAMES_PER_QUESTION
    radius: float = RADIUS_SECONDS
    max_frames: int = MAX_FRAMES_LENIENT
    frames_sent: int = FRAMES_SENT_LENIENT
    keep_rationale: bool = True
    debug: bool = False
    two_field: str = "hhmm"
    on_bad_video: str = "row"
    backend_options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in (STRICT, LENIENT):
            raise ValueError(f"mode must be '{STRICT}' or '{LENIENT}', not {self.mode!r}")
        if self.chat not in ("video", "images", "remote"):
            raise ValueError(f"chat must be 'video', 'images' or 'remote', not {self.chat!r}")
        if self.two_field not in ("hhmm", "mmss"):
            raise ValueError(f"two_field must be 'hhmm' or 'mmss', not {self.two_field!r}")
        if self.on_bad_video not in ("row", "fail"):
            raise ValueError(f"on_bad_video must be 'row' or 'fail', not {self.on_bad_video!r}")
        if self.max_frames < 1:
            raise ValueError("max_frames must be at least 1")

    @classmethod
    def strict(cls, max_frames: int = MAX_FRAMES_STRICT, **overrides) -> EvalConfig:
        """Closed answer set, retries on a miss, one video part per message."""
        return cls(**{
            "mode": STRICT, "chat": "video", "backend": "local", "max_frames": max_frames,
            "frames_sent": min(FRAMES_SENT_STRICT, max_frames),
            "backend_options": {"max_new_tokens": MAX_NEW_TOKENS_STRICT, "do_sample": False},
            **overrides,
        })

    @classmethod
    def lenient(cls, max_frames: int = MAX_FRAMES_LENIENT, **overrides) -> EvalConfig:
        """Unmatched replies are kept as text; one image part per frame."""
        return cls(**{
            "mode": LENIENT, "chat": "images", "backend": "local", "max_frames": max_frames,
            "frames_sent": min(FRAMES_SENT_LENIENT, max_frames),
            "backend_options": {"max_new_tokens": MAX_NEW_TOKENS_LENIENT},
            **overrides,
        })

    @classmethod
    def remote(cls, max_frames: int = MAX_FRAMES_LENIENT, **overrides) -> EvalConfig:
        """Lenient reply rules for an endpoint that takes frames as data URLs."""
        return cls(**{
            "mode": LENIENT, "chat": "remote", "backend": "remote", "max_frames": max_frames,
            "frames_sent": FRAMES_SENT_REMOTE,
            "backend_options": {"max_tokens": MAX_NEW_TOKENS_LENIENT, "temperature": 0.0},
            **overrides,
        })

    def with_options(self, **options) -> EvalConfig:
        """A copy with further backend options."""
        return replace(self, backend_options={**self.backend_options, **options})
