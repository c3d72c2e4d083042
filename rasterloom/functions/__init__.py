"""functions of the image-codec analytics engine."""
