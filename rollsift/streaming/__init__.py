"""Count-triggered stateful streams."""
