"""fathomline.functions"""
