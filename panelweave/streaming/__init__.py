"""No streaming operators: the model has batch panels only, keyed by an integer period."""
