"""Tables, manifests, delta segments and verified objects."""
