"""Small structures planned on the driver: layers, nets, fragments, pictures."""
