"""Reading and writing of images, mosaics, masks and cutouts."""
