"""Runs: persistent state, published artifacts, policy, outcomes and the commands over them."""
