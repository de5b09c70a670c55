"""The engine's workspace, under a name of this subpackage."""

from terraloom.store import Workspace, shared_dir, small_batches

__all__ = ["Workspace", "shared_dir", "small_batches"]
