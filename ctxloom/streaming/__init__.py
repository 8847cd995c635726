"""The engine's contract is batch only; there are no streaming operators."""
