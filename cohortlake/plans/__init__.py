"""Tables, their order and their gates."""
