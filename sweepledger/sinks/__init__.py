"""Writers of label lists, argument strings, manifests and verdicts."""
