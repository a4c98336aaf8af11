"""Tables and files that the driver and all executors share: the engine's staging."""

from thermoline.sources.staging import clear, shared_folder, stored

__all__ = ["clear", "shared_folder", "stored"]
