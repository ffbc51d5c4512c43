"""Chat-template rendering as native string expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is ``open + role + after_role + content + close``. The default is ChatML."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"

    @property
    def generation_header(self) -> str:
        return f"{self.open}assistant{self.after_role}"


CHATML = ChatTemplate()


def render_turn(role: Column, content: Column, template: ChatTemplate = CHATML) -> Column:
    """One turn; a missing text counts as an empty one."""
    said = F.coalesce(content, F.lit(""))
    return F.concat(F.lit(template.open), role, F.lit(template.after_role), said, F.lit(template.close))


def render_messages(
    messages: Column, template: ChatTemplate = CHATML, add_generation_prompt: bool = False
) -> Column:
    """The whole list as one string; optionally followed by the header of an assistant turn."""
    text = F.array_join(F.transform(messages, lambda m: render_turn(m["role"], m["content"], template)), "")
    return F.concat(text, F.lit(template.generation_header)) if add_generation_prompt else text


def prompt_messages(messages: Column) -> Column:
    """Messages before the first assistant message; all of them when there is none."""
    at = F.array_position(F.transform(messages, lambda m: m["role"]), F.lit("assistant"))
    return F.when(at > 0, F.slice(messages, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(messages)
