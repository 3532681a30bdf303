"""What a conversion job asks for, and whether it can be done."""
