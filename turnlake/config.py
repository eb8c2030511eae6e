"""Options of the components, with their defaults; None stands for the default wherever an option is given."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    preserve_recent_turns: int = 5
    max_context_tokens: int = 128_000
    system_prompt_reserve: int = 10_000
    compaction_threshold: float = 0.75
    tool_result_truncate_chars: int = 40_000
    max_compactions_per_cycle: int = 3
    topic_aware: bool = True
    tool_result_max_tokens: int = 500
    cross_topic_strategy: str = "summarize"
    same_topic_max_turns: int = 3

    @property
    def budget(self) -> int:
        return self.max_context_tokens - self.system_prompt_reserve

    @property
    def threshold(self) -> float:
        return self.budget * self.compaction_threshold

    @property
    def topic_target(self) -> float:
        return self.threshold * 0.8


@dataclass(frozen=True)
class ContextConfig:
    max_tokens: int = 128_000
    auto_summarize: bool = True
    summarize_threshold: float = 0.8
    preserve_system: bool = True
    preserve_recent_messages: int = 10
    strategy: str = "fifo"


@dataclass(frozen=True)
class TopicConfig:
    similarity_threshold: float = 0.05
    min_turns_per_topic: int = 2
    window: int = 3
    reference_turns: int = 3


def resolved(config, **options):
    """config with the options that are of the field's type; others, None among them, change nothing."""
    def fits(key, value):
        now = getattr(config, key, None)
        if isinstance(now, bool):
            return isinstance(value, bool)
        if isinstance(now, (int, float)):
            return isinstance(value, (int, float)) and not isinstance(value, bool)
        return isinstance(value, type(now))

    return replace(config, **{k: v for k, v in options.items() if hasattr(config, k) and v is not None and fits(k, v)})
