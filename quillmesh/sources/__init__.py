"""Where envelopes come from and where requests are kept."""
