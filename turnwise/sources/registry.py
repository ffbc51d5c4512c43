"""Known corpora: where they live, which split to take, and what role each column plays."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType


@dataclass(frozen=True)
class CorpusSpec:
    """``columns`` maps a role (``instruction``, ``prompt`` ...) to the column that plays it."""

    name: str
    path: str
    split: str
    columns: Mapping[str, str] = field(default_factory=dict)

    def column(self, role: str) -> str:
        return self.columns[role]


def _registry(*specs: CorpusSpec) -> Mapping[str, CorpusSpec]:
    return MappingProxyType({s.name: s for s in specs})


# --- fixed values: public corpus ids, their splits and column names ---------------------------
INSTRUCTION_CORPORA = _registry(
    CorpusSpec(
        "alpaca", "tatsu-lab/alpaca", "train",
        {"instruction": "instruction", "input": "input", "output": "output"},
    ),
    CorpusSpec(
        "sharegpt", "anon8231489123/ShareGPT_Vicuna_unfiltered", "train",
        {"conversation": "conversations"},
    ),
    CorpusSpec(
        "openorca", "Open-Orca/OpenOrca", "train",
        {"system": "system_prompt", "question": "question", "response": "response"},
    ),
)
PREFERENCE_CORPORA = _registry(
    CorpusSpec(
        "ultrafeedback", "HuggingFaceH4/ultrafeedback_binarized", "train_prefs",
        {"prompt": "prompt", "chosen": "chosen", "rejected": "rejected"},
    ),
    CorpusSpec("helpsteer", "nvidia/HelpSteer", "train"),
    CorpusSpec("anthropic_hh", "Anthropic/hh-rlhf", "train", {"chosen": "chosen", "rejected": "rejected"}),
)
INSTRUCTION_SPLITS = ("train",)
PREFERENCE_SPLITS = ("train_prefs", "train")
# -----------------------------------------------------------------------------------------------


def corpus_spec(registry: Mapping[str, CorpusSpec], name: str) -> CorpusSpec:
    """The entry for ``name``; an unknown name is an error that lists the known ones."""
    if name not in registry:
        raise ValueError(f"no corpus is registered as {name!r}; there are {', '.join(registry)}")
    return registry[name]


def instruction_spec(name: str) -> CorpusSpec:
    return corpus_spec(INSTRUCTION_CORPORA, name)


def preference_spec(name: str) -> CorpusSpec:
    return corpus_spec(PREFERENCE_CORPORA, name)
